"""Language ID by compression: the language whose dictionary makes a text smallest.

Each learned language has a raw-content zstandard dictionary of sample text. A text is cut
into blocks, every block is encoded with every dictionary, and the language with the
smallest sum wins. A narrow margin between the two best languages is a rejection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotflow.llm.common import learnable, only

UNKNOWN = "und"
RESULT = "lang_pred string, score double, margin double, accepted boolean"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, and how texts are encoded with them.

    zstandard stores a text of a few words as it is, with any dictionary. So a text of at
    most ``short`` bytes is encoded behind each of a language's ``leads`` (other sample text
    of the language), less what the leads take alone.
    """

    dictionaries: tuple[tuple[str, bytes], ...]
    leads: tuple[tuple[bytes, ...], ...] = ()
    block: int = 4096
    short: int = 256
    narrow: float = 0.001  # least relative margin that is accepted

    def judge(self) -> LanguageJudge:
        return LanguageJudge(self)


class LanguageJudge:
    """The model's encoders; built once per task, since they cannot be sent."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.names = [name for name, _ in model.dictionaries]
        self.encoders = [self._encoder(content) for _, content in model.dictionaries]
        self.alone = [sum(len(e.compress(x)) for x in leads) for e, leads in zip(self.encoders, model.leads)]

    @staticmethod
    def _encoder(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4,
            strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def sizes(self, text: str) -> list[float]:
        """Bytes of the whole text with each dictionary."""
        data = plain(text)
        if len(data) <= self.model.short and all(self.model.leads):
            behind = zip(self.encoders, self.model.leads, self.alone)
            most = max(map(len, self.model.leads))  # a language with fewer leads counts as if it had as many
            return [(sum(len(e.compress(x + data)) for x in leads) - alone) * most / len(leads) for e, leads, alone in behind]
        parts = [data[i : i + self.model.block] for i in range(0, len(data), self.model.block)]
        return [sum(map(len, map(e.compress, parts))) for e in self.encoders]

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, False
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else math.inf
        margin = (1 - best / second) if second > 0 else 0.0
        # Sizes as code lengths, tempered with the length: neighbouring bytes are not independent.
        scale = 1 + 0.02 * abs(best)
        score = 1 / sum(math.exp((best - s) / scale) for s in sizes)
        return self.names[order[0]], score, margin, margin >= self.model.narrow


def plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def fit(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = 300,
    longest: int = 20_000,
    dictionary_bytes: int = 131_072,
    leads: int = 8,
    lead_bytes: int = 1024,
) -> LanguageModel:
    """Dictionaries from at most ``per_language`` documents of each language.

    The sample is the documents with the smallest key hashes among the learnable ones that
    have a language, a letter and at most ``longest`` characters. A language without any such
    text is learned from longer ones, each cut to its first ``longest`` characters. Of a key
    with several texts the first in order counts. Only the sample reaches the driver.
    Languages are a closed set of labels, so their dictionaries are too. No labelled text: a
    model that answers ``und``.
    """
    rows = only(docs, key=key, lang=lang, text=text).where(
        learnable(F.col("key")) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")
    )
    sized = rows.withColumn("long", F.length("text") > longest)
    # One row for each language.
    shorter = F.broadcast(sized.groupBy("lang").agg(F.min("long").alias("least")))
    rows = sized.join(shorter, "lang").where(F.col("long") == F.col("least"))
    keys = rows.select("lang", "key", F.xxhash64("key").alias("hash")).withColumn("salt", F.pmod("hash", F.lit(64)))
    # Few of each salt first: no task sees all candidates of a frequent language.
    for group in (["lang", "salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("hash", "key"))
        keys = keys.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    picked = keys.select("lang", "key").distinct()
    # At most per_language keys of each language, and one text of each.
    own = rows.join(F.broadcast(picked), ["lang", "key"], "left_semi").select("lang", "key", F.substring("text", 1, longest).alias("text"))
    found = own.groupBy("lang", "key").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    for row in sorted(found, key=lambda r: (r.lang, r.key, r.text)):
        samples.setdefault(row.lang, []).append(plain(row.text))
    parts = [divide(texts, dictionary_bytes, leads, lead_bytes) for texts in samples.values()]
    return LanguageModel(tuple(zip(samples, (content for content, _ in parts))), tuple(found for _, found in parts))


def divide(texts: list[bytes], size: int, leads: int, lead_bytes: int) -> tuple[bytes, tuple[bytes, ...]]:
    """Equal shares of the texts as dictionary content (more of long ones if others are short), and leads.

    Leads are the ends of the longest texts, which the dictionary does not hold.
    """
    texts = sorted(texts, key=len)
    ends = []
    for i in range(len(texts) - 1, max(-1, len(texts) - 1 - leads), -1):
        cut = max(len(texts[i]) // 2, len(texts[i]) - lead_bytes)
        ends.append(texts[i][cut:] + b" ")
        texts[i] = texts[i][:cut]
    out, left = [], size
    for i, text in enumerate(sorted(texts, key=len)):
        part = text[: max(1, left // (len(texts) - i))]
        out.append(part)
        left -= len(part) + 1
        if left <= 0:
            break
    return b" ".join(out)[:size], tuple(ends)


def identify(text: Column, model: LanguageModel) -> Column:
    """``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted`` of whole texts.

    NULL, empty or letterless text: ``und``, score 0, not accepted. Languages that encode a
    text to equally few bytes: the first by name, margin 0, not accepted. A text of any
    length is encoded whole, block by block; repeated rows get equal answers.
    """

    @F.arrow_udf(RESULT)
    def judge_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = model.judge()
        for batch in batches:
            found = [judge(t.as_py()) for t in batch]
            names, scores, margins, accepted = zip(*found) if found else ((), (), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(accepted, pa.bool_())],
                ["lang_pred", "score", "margin", "accepted"],
            )

    return judge_language(text)

"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

A piece goes where the squared counts of open sequences, summed over residual gaps, become
smallest. Pieces are packed in independent shards; what a shard leaves in sequences that are
not full is packed again in fewer shards, until one bounded shard takes the rest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from slotflow.llm.common import only
from slotflow.session import cut_lineage

_PIECES = "key long, piece int, start long, length long, ids_crc32 long"
#: In text of these characters alone, Unicode composition changes nothing and the tokenizer's
#: own pattern finds the parts below. Words with any other character are left to the tokenizer.
_PLAIN = "\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_OTHER = re.compile(f"[^{_PLAIN}]")
_OTHER_WORD = re.compile(f"[^\t-\r ]*[^{_PLAIN}][^\t-\r ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t-\r 0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")


class WordTokenizer:
    """Ids of texts by a lower-casing word tokenizer, each distinct part encoded once.

    The tokenizer splits at white space and into parts, ends every part with a token that
    carries the end-of-word suffix, and encodes each part by itself. So parts of plain text
    are looked up; unseen ones are encoded together, without the steps that change nothing in
    them. Other words go through the whole tokenizer. Ids are little-endian unsigned 32-bit
    integers. The memory of parts is bounded.
    """

    MOST_PARTS = 600_000
    TOGETHER = 2048  # unseen parts in one call

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.other: set[str] = set()  # words and texts of the group that only the whole tokenizer can encode

    def __call__(self, texts: Iterable[str], together: int = 1 << 21) -> Iterator[bytes]:
        """The ids of each text; parts are learned for about ``together`` characters of texts at once."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self._divided(text))
            size += len(text)
            if size >= together:
                yield from self._encoded(group)
                group, size = [], 0
        yield from self._encoded(group)

    def _divided(self, text: str) -> list[str]:
        """Parts of plain text, other words, or the whole text if it holds a special token."""
        if any(s in text for s in self.special):
            self.other.add(text)
            return [text]
        if not _OTHER.search(text):
            return _PARTS.findall(text.lower())
        out, at = [], 0
        for word in _OTHER_WORD.finditer(text):
            out += _PARTS.findall(text[at : word.start()].lower())
            out.append(word.group())
            self.other.add(word.group())
            at = word.end()
        return out + _PARTS.findall(text[at:].lower())

    def _encoded(self, group: list[list[str]]) -> Iterator[bytes]:
        if len(self.known) > self.MOST_PARTS:
            self.known = {}
        new = set().union(*group)
        new.difference_update(self.known)
        for part in self.other & new:
            self.known[part] = np.array(self.whole.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self._learn(list(new - self.other))
        self.other = set()
        for parts in group:
            yield b"".join(map(self.known.__getitem__, parts))

    def _learn(self, plain: list[str]) -> None:
        for i in range(0, len(plain), self.TOGETHER):
            part = plain[i : i + self.TOGETHER]
            (found,) = self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            data, cuts = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer does not end every part with an end-of-word token")
            self.known.update(zip(part, (data[a:b] for a, b in zip([0, *cuts], cuts))))


def pieces(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", size: int = 2048, end: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document's ids and the end id, in pieces of ``size``.

    Only documents longer than ``size`` are cut. NULL and empty texts are the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = WordTokenizer(tokenizer), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            texts = (t.as_py() or "" for t in batch.column(1))
            for key_, ids in zip(batch.column(0), encode(texts)):
                data = memoryview(ids + tail)
                for i, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    rows.append((key_.as_py(), i, at // 4, len(part) // 4, crc32(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "piece", "start", "length", "ids_crc32"])

    return only(docs, key=key, text=text).select(F.col("key").cast("long"), "text").mapInArrow(cut, _PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length in the order given, and how full each bin is.

    With N(g) open bins of gap g, putting a length s into a bin of gap g changes the sum of
    squares by 2 N(g - s) - 2 N(g) + 2, a full bin (g = s) by 1 - 2 N(g), a new bin by
    2 N(size - s) + 1. Equal changes: the smallest gap, a new bin last.
    """
    count = np.zeros(size + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    filled: list[int] = []
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s == size:
            gap = size
        else:
            own, after = count[s:size], count[: size - s]
            change = np.where(own > 0, 2 * after - 2 * own + 2, never)
            if own[0] > 0:
                change[0] = 1 - 2 * own[0]
            best = int(change.argmin())
            gap = s + best if change[best] <= 2 * count[size - s] + 1 else size
        if gap == size:
            at = len(filled)
            filled.append(0)
        else:
            at = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = at, filled[at]
        filled[at] += s
        if gap > s:
            stacks[gap - s].append(at)
            count[gap - s] += 1
    return bins, offsets, np.array(filled, dtype=np.int64)


_ROUND = 1 << 48  # sequence ids of a round begin here and end far below the next


def pack(cut: DataFrame, *, size: int = 2048, shard: int = 32_768) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: sequences of at most ``size``, gapless from 0.

    Shards have about ``shard`` pieces, dealt by hash whatever the document. Each round keeps
    the full sequences and packs the pieces of all others again, longest first. The last round
    keeps all: it is the one with a single shard, or one whose pieces are over half of those
    before, as pieces that do not fill sequences would never get fewer. So no shard grows.
    """
    left = cut_lineage(cut.withColumn("at", F.monotonically_increasing_id()))
    done, first, before = [], 0, None
    while True:
        rows = left.count()
        shards = max(1, math.ceil(rows / shard))
        last = shards == 1 or (before is not None and 2 * rows > before)
        packed = cut_lineage(_packed(left, shards, size, first, last))
        if last:
            done.append(packed)
            break
        done.append(packed.where("full"))
        left = packed.where("not full").drop("sequence_id", "offset", "full")
        first, before = first + _ROUND, rows
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("at", "full")


def _packed(rows: DataFrame, shards: int, size: int, first: int, last: bool) -> DataFrame:
    """One round: each shard numbers its sequences from a place of its own."""
    kinds = "key long, piece int, start long, length long, ids_crc32 long, at long, sequence_id long, offset long, full boolean"

    def fill(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        table = table.drop_columns(["shard"]).sort_by([("length", "descending"), ("at", "ascending")])
        bins, offsets, filled = sum_of_squares(table.column("length").to_numpy(), size)
        ids = first + bins * shards + number
        whole = (filled == size)[bins] | last
        for name, values in (("sequence_id", ids), ("offset", offsets), ("full", whole)):
            table = table.append_column(name, pa.array(values))
        return table

    return rows.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards))).groupBy("shard").applyInArrow(fill, kinds)

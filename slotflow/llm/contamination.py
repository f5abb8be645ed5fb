"""Benchmark decontamination: a generalised suffix automaton of the normalised test items.

The words of a training text are streamed through the automaton, which knows after each word
the longest run of words up to there that stands in some item. Where that run reaches the
length limit, its last words are an occurrence of a window of that length. Items shorter than
the limit count as a whole: their states are marked, and a marked state on the chain of
suffixes of the current one ends an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotflow.llm.common import fresh, only, quoted
from slotflow.llm.words import Words, part_count, rows_of

LENGTH = 10
#: Bytes of item text in one automaton; more items are dealt to several, each sent by itself.
BLOCK_BYTES = 1 << 20
#: Longer items are cut into pieces that share all words of a window but one.
PIECE_WORDS = 4096

FOUND = "n_words long, n_hit long, spans array<struct<begin:long,end:long>>, items array<string>"
_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
_MERGED = pa.struct([("n_hit", pa.int64()), _FOUND.field("spans")])


class Automaton:
    """Suffix automaton of word sequences, held in plain lists and dictionaries."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], length: int) -> None:
        self.limit, self.ids = length, {}
        self.lengths, self.links, self.go = [0], [-1], {}
        self.step = 1 + sum(len(words) for _, words in pieces)  # more than there are different words
        self._out: list[list[int]] = [[]]  # words that leave a state, while building
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in pieces if words]
        for words in {tuple(words) for _, words in coded}:
            last = 0
            for word in words:
                last = self._extended(last, word)
        del self._out
        self._mark(coded)

    def _state(self, length: int, link: int) -> int:
        self.lengths.append(length)
        self.links.append(link)
        self._out.append([])
        return len(self.lengths) - 1

    def _lead(self, state: int, word: int, to: int) -> None:
        key = state * self.step + word
        if key not in self.go:
            self._out[state].append(word)
        self.go[key] = to

    def _split(self, state: int, word: int, to: int) -> int:
        """A copy of ``to`` for the runs that end in ``state`` and the word."""
        copy = self._state(self.lengths[state] + 1, self.links[to])
        for w in self._out[to]:
            self._lead(copy, w, self.go[to * self.step + w])
        self.links[to] = copy
        while state >= 0 and self.go.get(state * self.step + word) == to:
            self._lead(state, word, copy)
            state = self.links[state]
        return copy

    def _extended(self, last: int, word: int) -> int:
        to = self.go.get(last * self.step + word)
        if to is not None:  # the run is known from another sequence
            return to if self.lengths[to] == self.lengths[last] + 1 else self._split(last, word, to)
        new = self._state(self.lengths[last] + 1, 0)
        while last >= 0 and last * self.step + word not in self.go:
            self._lead(last, word, new)
            last = self.links[last]
        if last >= 0:
            to = self.go[last * self.step + word]
            self.links[new] = to if self.lengths[to] == self.lengths[last] + 1 else self._split(last, word, to)
        return new

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        """Which items hold the window of a state, and which whole short items end in it."""
        go, links, lengths = self.go, self.links, self.lengths
        self.windows = [-1] * len(lengths)  # the state of the last ``limit`` words, for long enough runs
        self.marked = [-1] * len(lengths)  # the nearest suffix state that is a whole short item
        self.holders: dict[int, set[str]] = {}
        self.whole: dict[int, int] = {}
        for name, words in coded:
            state = 0
            for i, word in enumerate(words):
                state = go[state * self.step + word]
                if i + 1 >= self.limit:
                    while lengths[links[state]] >= self.limit:
                        state = links[state]
                    self.holders.setdefault(state, set()).add(name)
            if len(words) < self.limit:
                self.whole[state] = len(words)
                self.holders.setdefault(state, set()).add(name)
        for state in sorted(range(1, len(lengths)), key=lengths.__getitem__):
            link = links[state]
            if lengths[state] >= self.limit:
                self.windows[state] = self.windows[link] if lengths[link] >= self.limit else state
            self.marked[state] = state if state in self.whole else self.marked[link]
        self.marks = bool(self.whole)

    def scan(self, words: list[bytes]) -> tuple[bytearray, set[int]] | None:
        """A flag for each word inside an occurrence, and the states that occurred; None without any."""
        go, step, links, lengths, limit, marks = self.go, self.step, self.links, self.lengths, self.limit, self.marks
        state = run = 0
        flags, states = None, set()
        for i, word in enumerate(map(self.ids.get, words)):
            if word is None:
                state = run = 0
                continue
            to = go.get(state * step + word)
            while to is None:
                state = links[state]
                if state < 0:
                    break
                run = lengths[state]
                to = go.get(state * step + word)
            if to is None:
                state = run = 0
                continue
            state, run = to, run + 1
            if run >= limit:
                flags = flags or bytearray(len(words))
                flags[i + 1 - limit : i + 1] = b"\1" * limit
                states.add(self.windows[state])
            if marks:
                mark = self.marked[state]
                while mark >= 0:
                    n = self.whole[mark]
                    if n <= run:
                        flags = flags or bytearray(len(words))
                        flags[i + 1 - n : i + 1] = b"\1" * n
                        states.add(mark)
                    mark = self.marked[links[mark]]
        return (flags, states) if flags else None

    def names(self, states: set[int]) -> list[str]:
        found = set().union(*(self.holders[s] for s in states))
        found.discard(None)
        return sorted(found)


def _spans(flags: bytearray) -> list[dict]:
    """Runs of flagged words as (first word, word after the last)."""
    out, end = [], 0
    while (begin := flags.find(1, end)) >= 0:
        end = flags.find(0, begin)
        end = len(flags) if end < 0 else end
        out.append({"begin": begin, "end": end})
    return out


def _pieces(items: DataFrame, length: int, most_words: int) -> DataFrame:
    """(name, part, words): items as normalised words joined by spaces, long ones in overlapping pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words(digits=True)
        for batch in batches:
            names, parts, texts = [], [], []
            for name, text in rows_of(batch, "name", "text"):
                words = split(text)
                for part, at in enumerate(range(0, max(1, len(words) - length + 1), most_words)):
                    names.append(name)
                    parts.append(part)
                    texts.append(b" ".join(words[at : at + most_words + length - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.int64()), pa.array(texts, pa.binary())], ["name", "part", "words"])

    return items.mapInArrow(cut, "name string, part long, words binary").where(F.octet_length("words") > 0)


def _automata(items: DataFrame, length: int, block_bytes: int, piece_words: int) -> Iterator[Automaton]:
    pieces = _pieces(items, length, piece_words)
    blocks = part_count(pieces, F.octet_length("words"), block_bytes)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("name", "part", "words"), F.lit(blocks)))
    for block in range(blocks):
        # About block_bytes of text: all that reaches the driver at once.
        rows = dealt.where(F.col("block") == block).select("name", "words").collect()
        yield Automaton([(r["name"], bytes(r["words"]).split()) for r in rows], length)


def _matched(spark, text: Column, automaton: Automaton) -> Column:
    sent = spark.sparkContext.broadcast(vars(automaton))

    @F.arrow_udf(FOUND)
    def occurrences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split, known = Words(digits=True), Automaton.__new__(Automaton)
        known.__dict__ = sent.value
        for batch in batches:
            out = []
            for value in batch:
                words = split(value.as_py())
                found = known.scan(words)
                flags, states = found or (b"", set())
                out.append({"n_words": len(words), "n_hit": sum(flags), "spans": _spans(flags) if found else [], "items": known.names(states) if found else []})
            yield pa.array(out, _FOUND)

    return occurrences(text.cast("binary"))


def _merged(lists: Column) -> Column:
    """Spans of several automata as one ascending list without overlaps, and the words in them."""

    @F.arrow_udf("n_hit long, spans array<struct<begin:long,end:long>>")
    def merge_spans(lists: pa.Array) -> pa.Array:
        out = []
        for spans in lists:
            held: list[dict] = []
            for span in sorted(spans.as_py() or [], key=lambda s: (s["begin"], s["end"])):
                if held and span["begin"] <= held[-1]["end"]:
                    held[-1]["end"] = max(held[-1]["end"], span["end"])
                else:
                    held.append(span)
            out.append({"n_hit": sum(s["end"] - s["begin"] for s in held), "spans": held})
        return pa.array(out, _MERGED)

    return merge_spans(lists)


def occurrences(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    length: int = LENGTH,
    out: str = "found",
    block_bytes: int = BLOCK_BYTES,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """All rows and columns of ``docs``, and ``out``: n_words, n_hit, spans of words, items (ascending, as text).

    Windows are ``length`` consecutive words of an item, or a whole shorter item. NULL and
    empty texts have no words and no hits; items without words have no window. An item without
    a key marks words but is not named; rows with equal keys are one item. Repeated rows of
    ``docs`` get equal answers, a text of any length is streamed whole. One automaton holds
    about ``block_bytes`` of items: one for all is a pass without a shuffle; of several, each
    is sent in a pass of its own, and what they found is joined by the hash of the text.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    spark, body = docs.sparkSession, docs[quoted(text)]
    out = fresh(out, docs.columns)
    known = only(items, name=item_key, text=item_text).select(F.col("name").cast("string"), F.col("text").cast("binary"))
    automata = list(_automata(known, length, block_bytes, piece_words))
    if len(automata) == 1:
        return docs.withColumn(out, _matched(spark, body, automata[0]))
    names = {c: fresh(f"__{c}", [*docs.columns, out]) for c in ("h1", "h2", "k1", "k2", "found")}
    hashed = docs.withColumns({names["h1"]: F.xxhash64(body), names["h2"]: F.xxhash64(F.lit("second"), body)})
    key = [F.col(names["h1"]).alias(names["k1"]), F.col(names["h2"]).alias(names["k2"])]
    each = [
        # Copies of a text are one row of each pass.
        hashed.select(*key, _matched(spark, body, a).alias("f")).where("f.n_words > 0").groupBy(names["k1"], names["k2"]).agg(F.first("f").alias("f"))
        for a in automata
    ]
    both = (
        reduce(DataFrame.unionAll, each)
        .groupBy(names["k1"], names["k2"])
        .agg(F.max("f.n_words").alias("n"), F.flatten(F.collect_list("f.spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"))
        .withColumn("m", _merged(F.col("s")))
        .select(names["k1"], names["k2"], F.struct(F.col("n").alias("n_words"), "m.n_hit", "m.spans", "items").alias(names["found"]))
    )
    none = F.from_json(F.lit('{"n_words":0,"n_hit":0,"spans":[],"items":[]}'), FOUND)
    met = (F.col(names["h1"]) == F.col(names["k1"])) & (F.col(names["h2"]) == F.col(names["k2"]))
    return hashed.join(both, met, "left").select(*(hashed[quoted(c)] for c in docs.columns), F.coalesce(names["found"], none).alias(out))


def _without(text: Column, spans: Column) -> Column:
    """Whole texts without the words of the spans and what stands between those words."""

    @F.arrow_udf("string")
    def cut_words(texts: pa.Array, lists: pa.Array) -> pa.Array:
        split, out = Words(digits=True), []
        for text, spans in zip(texts, lists):
            data, spans = text.as_py(), spans.as_py()
            if data and spans:
                places, at, parts = split.places(data), 0, []
                for span in spans:
                    parts.append(data[at : places[span["begin"]][0]])
                    at = places[span["end"] - 1][1]
                data = b"".join([*parts, data[at:]])
            out.append(data)
        return pa.array(out, pa.binary()).cast(pa.string())

    return cut_words(text.cast("binary"), spans)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    length: int = LENGTH,
    coverage: float = 0.5,
    removed: str | None = None,
) -> DataFrame:
    """``docs`` without benchmark passages: spans of hit words are cut out of ``text``.

    A row of whose words a larger share than ``coverage`` is hit goes as a whole; rows without
    words stay. ``removed`` names a column for the number of words cut. Windows, odd rows
    and blocks are those of :func:`occurrences`.
    """
    judged = fresh("__found", docs.columns)
    found = occurrences(docs, items, text=text, item_key=item_key, item_text=item_text, length=length, out=judged)
    hit = F.col(f"{judged}.n_hit")
    kept = found.where(hit <= F.lit(float(coverage)) * F.col(f"{judged}.n_words"))
    clean = F.when(hit > 0, _without(F.col(quoted(text)), F.col(f"{judged}.spans"))).otherwise(F.col(quoted(text)))
    columns = [clean.alias(c) if c.lower() == text.lower() else F.col(quoted(c)) for c in docs.columns]
    return kept.select(*columns, *([hit.alias(removed)] if removed else []))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NEXT = ", ".join(f"lead(w, {i}) OVER p AS w{i}" for i in range(1, LENGTH))
_RUN = ", ".join(["w", *(f"CASE WHEN k > {i} THEN w{i} END" for i in range(1, LENGTH))])
_LAST = "CASE k WHEN 1 THEN w " + " ".join(f"WHEN {i + 1} THEN w{i}" for i in range(1, LENGTH)) + " END"

#: The digest of :func:`occurrences` in DuckDB SQL over ``documents`` and ``benchmark``.
SQL = f"""
WITH items AS (SELECT row_number() OVER () AS r, item_id, {_WORDS} AS ws FROM benchmark),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
item_words AS (
  SELECT r, item_id, least(len(ws), {LENGTH}) AS k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM items),
item_runs AS (SELECT *, {_NEXT} FROM item_words WINDOW p AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT DISTINCT item_id, k, concat_ws(' ', {_RUN}) AS run FROM item_runs WHERE {_LAST} IS NOT NULL),
doc_words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
doc_runs AS (SELECT *, {_NEXT} FROM doc_words WINDOW p AS (PARTITION BY r ORDER BY i)),
sized AS (
  SELECT r, i, k, concat_ws(' ', {_RUN}) AS run FROM doc_runs, (SELECT DISTINCT k FROM windows) WHERE {_LAST} IS NOT NULL),
found AS (SELECT s.r, s.i, s.k, x.item_id FROM sized s JOIN windows x ON s.k = x.k AND s.run = x.run),
hit AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS place FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.r = d.r LEFT JOIN named n ON n.r = d.r
"""

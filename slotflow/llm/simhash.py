"""SimHash near-dedup: 64-bit fingerprints linked at a few differing bits.

Candidates come from an inverted index on positional bytes. Two fingerprints that differ in
d bits share at least 8 - d of their 8 bytes (the guaranteed minimum, 4 for d = 4). Postings
are keyed by three positions and their bytes: the triples are chosen so that any four shared
positions hold one of them, so every pair that can reach the minimum meets in a posting. There
the shared positional bytes are tallied, pairs below the minimum are dropped, and the rest
verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotflow.llm.common import fresh, only, quoted
from slotflow.llm.components import components
from slotflow.session import cut_lineage

#: Fingerprints of a posting with more members than this are linked by ``_crowded`` instead.
LONGEST_POSTING = 8_192


def triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the 8 byte positions, one inside any four positions (Turan's construction).

    Positions fall into three classes; a triple has its positions in one class, or two in one
    class and one in the next.
    """
    home = [0, 0, 0, 1, 1, 1, 2, 2]

    def fits(triple: tuple[int, ...]) -> bool:
        count = [sum(home[p] == c for p in triple) for c in range(3)]
        return any(count[c] == 3 or (count[c] == 2 and count[(c + 1) % 3] == 1) for c in range(3))

    return [t for t in combinations(range(8), 3) if fits(t)]


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The SimHash of a whole text as a long (its 64 bits; 0 without words, also for NULL).

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``shingle``
    successive words joined by a space, repeats included; fewer words are one shingle. A bit
    is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    """

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_simhash(t.as_py(), shingle) for t in batch], pa.int64())

    return simhash(text)


def _simhash(text: str | None, shingle: int, block: int = 65_536) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = begins[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, block):  # bounds the memory for very long texts
        h = np.array([digest(joined[a:b], 42) for a, b in zip(first[i : i + block], last[i : i + block])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def near_duplicates(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 4, bits: int = 4, longest_posting: int = LONGEST_POSTING
) -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    ``component_id`` is the smallest key reachable over links of at most ``bits`` differing
    bits, its own included. Rows without words have fingerprint 0 and are linked like any
    other. Equal fingerprints are one node, so copies are never paired. Rows with equal keys
    are one document that links its fingerprints. A row without a key is linked like any other;
    ``component_id`` is NULL where no row of a component has a key.
    """
    prints, roots = _judged(only(docs, key=key, text=text), shingle, bits, longest_posting)
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(roots, "print", "left").select(F.col("key").alias(key), hexed.alias("fingerprint"), "component_id")


def _judged(rows: DataFrame, shingle: int, bits: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(key, print) of the rows; (print, root, component_id): the smallest fingerprint and key of its component."""
    if not 0 <= bits <= 4:
        raise ValueError("the index finds pairs that share four bytes: at most 4 differing bits")
    prints = cut_lineage(rows.select("key", fingerprint(F.col("text"), shingle).alias("print")))
    nodes = cut_lineage(prints.groupBy("print").agg(F.min("key").alias("key")))
    keyed = prints.where(F.col("key").isNotNull())
    several = keyed.groupBy("key").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low != high")
    own = keyed.join(several, "key").select(F.col("print").alias("a"), F.col("low").alias("b"))
    found = components(links(nodes.select("print", F.col("print").alias("node")), bits, longest).unionByName(own))
    members = nodes.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "key", F.coalesce("component", "print").alias("root"))
    # Held, so that adaptive execution can split the join of a large component.
    least = cut_lineage(members.groupBy("root").agg(F.min("key").alias("component_id")))
    return prints, members.join(least, "root").select("print", "root", "component_id")


def keep_first(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 4, bits: int = 4) -> DataFrame:
    """All columns of one row of each component: the one with its smallest key.

    Of several rows with that key one stays, the one with the smallest fingerprint. Rows
    without a key go if a row with a key is in their component; else one row stays, the one
    with the smallest fingerprint.
    """
    prints, roots = _judged(only(docs, key=key, text=text), shingle, bits, LONGEST_POSTING)
    chosen = F.col("key").eqNullSafe(F.col("component_id")) & (F.col("key").isNotNull() | (F.col("print") == F.col("root")))
    first = cut_lineage(prints.join(roots, "print", "left").where(chosen).groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    at = fresh("__key", docs.columns)
    once = first.where(F.col("key").isNotNull() & (F.col("rows") == 1)).select(F.col("key").alias(at))
    kept = docs.join(once.hint("shuffle_hash"), docs[quoted(key)] == F.col(at), "left_semi")
    rest = first.where(F.col("key").isNull() | (F.col("rows") > 1)).select(F.col("key").alias(at))
    if rest.isEmpty():
        return kept
    # Repeated keys and rows without one: told apart by fingerprint and text.
    code, place, least, root, code2 = (fresh(n, [*docs.columns, at]) for n in ("__print", "__place", "__least", "__root", "__print2"))
    marked = docs.join(rest, docs[quoted(key)].eqNullSafe(F.col(at)), "left_semi").withColumn(code, fingerprint(docs[quoted(text)], shingle))
    marked = marked.join(roots.select(F.col("print").alias(code2), F.col("component_id").alias(least), F.col("root").alias(root)), F.col(code) == F.col(code2), "left")
    group = F.when(F.col(quoted(key)).isNull(), F.col(code)).otherwise(F.lit(0))
    order = Window.partitionBy(quoted(key), group).orderBy(code, F.xxhash64(quoted(text)))
    chosen = F.col(quoted(key)).eqNullSafe(F.col(least)) & (F.col(quoted(key)).isNotNull() | (F.col(code) == F.col(root)))
    again = marked.where(chosen).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.unionByName(again.select(*(F.col(quoted(c)) for c in docs.columns)))


def links(nodes: DataFrame, bits: int, longest: int = LONGEST_POSTING) -> DataFrame:
    """(a, b): links between the nodes of distinct fingerprints, enough to connect all that are near.

    Postings are dealt by ranges of (posting, fingerprint), so that a long one spans partitions
    and none gathers in a task. A partition links the postings that lie wholly inside it. It
    hands on those at its borders and those over ``longest``; of these the short ones are
    linked in a second pass, and ``_crowded`` links what is in the long ones.
    """
    number = F.posexplode(F.array(*(_posting(F.col("print"), i, t) for i, t in enumerate(triples()))))
    postings = nodes.select("print", "node", number.alias("number", "posting")).select("posting", "print", "node")
    spread = postings.repartitionByRange("posting", "print").sortWithinPartitions("posting", "print")
    schema = "posting long, print long, a long, b long"
    linked = cut_lineage(spread.mapInArrow(_linker(bits, longest, True), schema))
    handed = linked.where(F.col("b").isNull()).select("posting", "print", F.col("a").alias("node"))
    # One posting of more than ``longest`` rows at most for each so many rows: few, and no key of a join.
    long_ones = F.broadcast(handed.groupBy("posting").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > longest).select("posting"))
    short = handed.join(long_ones, "posting", "left_anti").select("posting", "print", "node")
    short = short.repartition("posting").sortWithinPartitions("posting", "print").mapInArrow(_linker(bits, longest, False), schema)
    long = handed.join(long_ones, "posting", "left_semi").select("print", "node").distinct()
    pairs = [linked.where(F.col("b").isNotNull()).select("a", "b"), short.select("a", "b")]
    return pairs[0].unionByName(pairs[1]).unionByName(_crowded(long, bits))


def _posting(code: Column, number: int, triple: tuple[int, int, int]) -> Column:
    """The number of the triple and the bytes at its positions, as one long."""
    out = F.lit(number).cast("long")
    for p in triple:
        byte = F.shiftrightunsigned(code, 8 * (7 - p)).bitwiseAND(F.lit(255).cast("long"))
        out = F.shiftleft(out, 8).bitwiseOR(byte)
    return out


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # posting, print, node


def _linker(bits: int, longest: int, borders: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links inside whole runs of a posting in sorted partitions; other rows are handed on, b NULL."""

    def link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = passing = None  # the partition's first posting; one that is too long
        still: Rows | None = None  # the run that is not ended yet
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if still is not None:
                rows = tuple(np.concatenate(x) for x in zip(still, rows))
            if first is None and borders:
                first = rows[0][0]
            last = rows[0][-1]
            cut = int(np.searchsorted(rows[0], last))
            yield from _closed(tuple(x[:cut] for x in rows), first, passing, bits, longest)
            still = tuple(x[cut:] for x in rows)
            if len(still[0]) > longest:
                yield _batch(*still, None)
                still, passing = None, last
        if still is not None and borders:
            yield _batch(*still, None)
        elif still is not None:
            yield from _closed(still, first, passing, bits, longest)

    return link_runs


def _closed(rows: Rows, first: int | None, passing: int | None, bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Links of ended runs; the first run of a partition and long runs are handed on."""
    if not len(rows[0]):
        return
    _, inverse, size = np.unique(rows[0], return_inverse=True, return_counts=True)
    run = size[inverse]
    hand = run > longest
    for posting in (first, passing):
        if posting is not None:
            hand |= rows[0] == posting
    if hand.any():
        yield _batch(*(x[hand] for x in rows), None)
    few = ~hand & (run > 1) & (run <= _PAIRED)
    i, j = _near_pairs(tuple(x[few] for x in rows), bits)
    if len(i):
        node = rows[2][few]
        yield _batch(rows[0][few][i], rows[1][few][i], node[i], node[j])
    many = ~hand & (run > _PAIRED)
    if many.any():
        own = tuple(x[many] for x in rows)
        cuts = np.flatnonzero(np.diff(own[0])) + 1
        for code, node, posting in zip(*(np.split(x, cuts) for x in (own[1], own[2], own[0]))):
            i, j = _spanning(code, bits)
            if len(i):
                yield _batch(posting[i], code[i], node[i], node[j])


_PAIRED = 16  # longer runs get a spanning forest in place of their pairs


def _tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many positional bytes two fingerprints share, from their XOR; and which, as a mask."""
    same = np.ascontiguousarray(x).astype(">u8").view(np.uint8).reshape(-1, 8) == 0
    return same.sum(axis=1), np.packbits(same, axis=1)[:, 0]


def _first_triple() -> np.ndarray:
    """For each mask of shared positions, the number of the first triple inside it."""
    out = np.full(256, -1)
    for mask in range(256):
        held = {p for p in range(8) if mask >> (7 - p) & 1}
        out[mask] = next((i for i, t in enumerate(triples()) if held.issuperset(t)), -1)
    return out


def _near_pairs(rows: Rows, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near fingerprints in equal postings; each pair at its first shared posting only."""
    posting, code = rows[0], rows[1].view(np.uint64)
    left, right, first = [], [], _first_triple()
    for step in range(1, _PAIRED):
        i = np.flatnonzero(posting[step:] == posting[:-step]) if len(posting) > step else np.array([], dtype=int)
        if not len(i):
            break
        x = code[i] ^ code[i + step]
        count, mask = _tally(x)
        ok = (count >= 8 - bits) & (first[mask] == posting[i] >> 24) & (np.bitwise_count(x) <= bits)
        left.append(i[ok])
        right.append(i[ok] + step)
    empty = np.array([], dtype=int)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _spanning(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect exactly what near pairs connect, one fewer than members."""
    code, left = prints.view(np.uint64), np.arange(len(prints))
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            x = code[left] ^ code[i]
            near = np.flatnonzero(_tally(x)[0] >= 8 - bits)
            near = near[np.bitwise_count(x[near]) <= bits]
            found = left[near]
            a += [i] * len(found)
            b += found.tolist()
            todo += found.tolist()
            left = np.delete(left, near)
    return np.array(a, dtype=int), np.array(b, dtype=int)


def _batch(posting, code, a, b) -> pa.RecordBatch:
    end = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(posting, pa.int64()), pa.array(code, pa.int64()), pa.array(a, pa.int64()), end], ["posting", "print", "a", "b"])


def _crowded(nodes: DataFrame, bits: int) -> DataFrame:
    """Links of fingerprints from postings that are too long, without comparing them.

    Two fingerprints differ in at most d bits if and only if flipping up to ceil(d/2) bits of
    one and up to floor(d/2) of the other can make them meet. Every fingerprint goes to all
    codes it can reach (2,081 for d = 4); at a code all are linked to the smallest that reaches
    it with the fewer flips. Work grows with the fingerprints, and a code is reached by at
    most as many distinct fingerprints as there are flips.
    """
    more, fewer = (bits + 1) // 2, bits // 2
    flips = [(sum(1 << p for p in at), n <= fewer) for n in range(more + 1) for at in combinations(range(64), n)]
    signed = [(m - (1 << 64) if m >> 63 else m, near) for m, near in flips]
    near = F.array(*(F.lit(m) for m, ok in signed if ok))
    far = F.array(*(F.lit(m) for m, ok in signed if not ok)) if more > fewer else F.array().cast("array<bigint>")
    reach = F.explode(F.concat(F.transform(near, lambda m: F.struct(F.col("print").bitwiseXOR(m).alias("code"), F.lit(True).alias("near"))), F.transform(far, lambda m: F.struct(F.col("print").bitwiseXOR(m).alias("code"), F.lit(False).alias("near")))))
    met = nodes.select("node", reach.alias("r")).select("node", "r.code", "r.near")
    hub = F.min(F.when(F.col("near"), F.col("node"))).over(Window.partitionBy("code"))
    return met.withColumn("hub", hub).where("hub != node").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()

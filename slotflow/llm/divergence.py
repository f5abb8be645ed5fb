"""Source divergence audit: how far the term shares of the sources of a language lie apart.

A first pass counts exactly in how many documents of its language each term stands; terms
below the limit go. The kept terms are dealt to shards, and a minimal perfect hash of each shard
(hash and displace) gives every kept term a slot of its own. The shards are broadcast, each
with its keys, so that a term that was not kept is told apart by comparison. The second pass
counts every kept term again, in dense slots of the groups (language, source).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotflow.llm.common import only
from slotflow.llm.words import Words, part_count, rows_of
from slotflow.session import cut_lineage

SCALE, ADDED = 1_000_000_000, 5
LEAST_DOCS, RANKS = 30, 50
SHARD_KEYS = 4096  # kept terms of a shard, on average
#: Bytes of shards broadcast at once; more are sent in several volumes, each with a pass of its own.
VOLUME_BYTES = 1 << 26
HELD_TERMS = 1 << 19  # different terms a task counts before it hands them on
HELD_SLOTS = 1 << 23  # dense slots of a task, likewise
SOURCES = 128  # sources of a block: each pair of blocks is compared shard by shard
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
BUCKET = 3  # keys of a bucket with one displacement, on average


# --- minimal perfect hashing -------------------------------------------------------------------


def _mixed(term: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(term, seed)


def displaced(keys: list[bytes]) -> tuple[int, np.ndarray, list[int]]:
    """(seed, displacements, slot of each key): different keys get different slots below their number.

    Keys fall into buckets. The largest buckets are placed first: the least displacement that
    sends all keys of a bucket to free slots. A bucket of one key takes a free slot
    directly, stored as -1 - slot. Another seed is tried if two keys of a bucket cannot part.
    """
    n, buckets = len(keys), max(1, len(keys) // BUCKET)
    for seed in range(64):
        mixed = [_mixed(term, seed) for term in keys]
        if len(set(mixed)) < n:
            continue
        members: list[list[int]] = [[] for _ in range(buckets)]
        for i, h in enumerate(mixed):
            members[h % buckets].append(i)
        moves, slots, taken = np.zeros(buckets, dtype=np.int64), [0] * n, bytearray(n)
        free = 0
        for b in sorted(range(buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) > 1:
                for move in range(64 * n + 4096):
                    found = {_slot(mixed[i], move, n) for i in own}
                    if len(found) == len(own) and not any(taken[s] for s in found):
                        break
                else:
                    break
                moves[b] = move
                for i in own:
                    slots[i] = _slot(mixed[i], move, n)
                    taken[slots[i]] = 1
            elif own:
                free = taken.find(0, free)
                moves[b], slots[own[0]], taken[free] = -1 - free, free, 1
        else:
            return seed, moves, slots
    raise ValueError("no perfect hash found: keys repeat")


def _slot(h: int, move: int, n: int) -> int:
    if move < 0:
        return -1 - move
    # The hash multiplies its own halves changed over, and the upper bits of the product choose the slot.
    turned = (h >> 32) | (h << 32) & _MASK
    return (((turned + move * _STEP) * (h | 1) & _MASK) >> 32) % n


class Shards:
    """Perfect hashes of some shards of some languages; a lookup ends with a comparison with the stored key.

    Every language has its own shards, dealt by the hash of the term, and its own row of slots:
    those of the shards held here, one behind the other.
    """

    def __init__(self, rows: list[tuple[bytes, int, int, int, np.ndarray, list[bytes]]]) -> None:
        """``rows``: language, its number of shards, shard, seed, displacements, keys in the order of slots."""
        self.held: dict[bytes, dict] = {}
        self.size: dict[bytes, int] = {}
        for lang, shards, shard, seed, moves, keys in sorted(rows, key=lambda r: r[:3]):
            # by shard: first slot, slots (0: not held here), first displacement, displacements, seed
            own = self.held.setdefault(lang, {"shards": np.zeros((5, shards), dtype=np.int64), "moves": [], "keys": []})
            own["shards"][:, shard] = len(own["keys"]), len(keys), sum(map(len, own["moves"])), len(moves), seed
            own["moves"].append(moves)
            own["keys"] += keys
        for lang, own in self.held.items():
            own["moves"], self.size[lang] = np.concatenate(own["moves"]), len(own["keys"])

    def slots(self, lang: bytes, terms: list[bytes]) -> np.ndarray:
        """The slot of each kept term, -1 of any other."""
        own = self.held.get(lang)
        out = np.full(len(terms), -1, dtype=np.int64)
        if own is None or not terms:
            return out
        shard = np.fromiter(map(crc32, terms), dtype=np.int64, count=len(terms)) % own["shards"].shape[1]
        first, n, base, buckets, seed = own["shards"][:, shard]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), dtype=np.uint64, count=len(terms))
        for i in np.flatnonzero(seed):
            h[i] = _mixed(terms[i], int(seed[i]))
        some = np.flatnonzero(n)
        first, n, h = first[some], n[some].astype(np.uint64), h[some]
        move = own["moves"][base[some] + (h % buckets[some].astype(np.uint64)).astype(np.int64)]
        half = np.uint64(32)
        turned = (h >> half) | (h << half)
        far = (((turned + move.astype(np.uint64) * np.uint64(_STEP)) * (h | np.uint64(1))) >> half) % n
        at = first + np.where(move < 0, -1 - move, far.astype(np.int64))
        keys = own["keys"]
        same = np.fromiter((keys[s] == terms[i] for s, i in zip(at.tolist(), some.tolist())), dtype=bool, count=len(some))
        out[some[same]] = at[same]
        return out


# --- passes over the documents -----------------------------------------------------------------


def _document_counts(rows: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many documents of its language each term stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = Words(digits=False), {}
        size = 0
        for batch in batches:
            for lang, text in rows_of(batch, "lang", "text"):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(set(split(text)))
                size += len(own)
                if size >= HELD_TERMS:
                    yield _counted(held)
                    held, size = {}, 0
        yield _counted(held)

    def _counted(held: dict[bytes, Counter]) -> pa.RecordBatch:
        langs = pa.concat_arrays([pa.array([], pa.binary()), *(pa.repeat(pa.scalar(lang, pa.binary()), len(own)) for lang, own in held.items())])
        terms = [t for own in held.values() for t in own]
        docs = [n for own in held.values() for n in own.values()]
        return pa.RecordBatch.from_arrays([langs, pa.array(terms, pa.binary()), pa.array(docs, pa.int64())], ["lang", "term", "docs"])

    found = rows.select("lang", "text").mapInArrow(count, "lang binary, term binary, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _hashed(kept: DataFrame, shard_keys: int) -> DataFrame:
    """(lang, shards, shard, seed, moves, terms): a perfect hash of each shard, its terms in the order of slots."""

    def build(table: pa.Table) -> pa.Table:
        keys = table["term"].to_pylist()
        seed, moves, slots = displaced(keys)
        placed = [keys[i] for i in np.argsort(slots)]
        made = {"seed": pa.array([seed], pa.int32()), "moves": pa.array([moves.tolist()], pa.list_(pa.int64())), "terms": pa.array([placed], pa.list_(pa.binary()))}
        return pa.table({c: table[c][:1] for c in ("lang", "shards", "shard")} | made)

    number = F.ceil(F.count(F.lit(1)) / shard_keys).cast("int")
    dealt = kept.join(kept.groupBy("lang").agg(number.alias("shards")), "lang").withColumn("shard", (F.crc32("term") % F.col("shards")).cast("int"))
    shape = "lang binary, shards int, shard int, seed int, moves array<long>, terms array<binary>"
    return dealt.select("lang", "shards", "shard", "term").groupBy("lang", "shard").applyInArrow(build, shape)


def _volumes(hashed: DataFrame, volume_bytes: int) -> Iterator[Shards]:
    """The shards in volumes of about ``volume_bytes``: what reaches the driver, and each task, at once."""
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 64) + 8 * F.size("moves")
    volumes = part_count(hashed, size, volume_bytes)
    dealt = hashed.withColumn("volume", F.pmod(F.xxhash64("lang", "shard"), F.lit(volumes)))
    for v in range(volumes):
        rows = dealt.where(F.col("volume") == v).collect()
        yield Shards([(bytes(r["lang"]), r["shards"], r["shard"], r["seed"], np.array(r["moves"], dtype=np.int64), [bytes(t) for t in r["terms"]]) for r in rows])


def _recount(rows: DataFrame, volume: Shards, held_slots: int) -> DataFrame:
    """(lang, source, shard, slot, count): occurrences of the kept terms of a volume in each group."""
    sent = rows.sparkSession.sparkContext.broadcast(vars(volume))
    columns = ["lang", "source", "shard", "slot", "count"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = Words(digits=False), Shards.__new__(Shards)
        known.__dict__ = sent.value
        dense: dict[tuple[bytes, bytes], np.ndarray] = {}
        held = 0

        def filled() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in dense.items():
                of = known.held[lang]["shards"]
                numbers = np.flatnonzero(of[1])  # shards held here, in the order of their slots
                firsts = of[0, numbers]
                at = np.flatnonzero(own)
                where = np.searchsorted(firsts, at, side="right") - 1
                arrays = [pa.repeat(pa.scalar(x, pa.binary()), len(at)) for x in (lang, source)]
                arrays += [pa.array(numbers[where], pa.int32()), pa.array(at - firsts[where], pa.int32()), pa.array(own[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, columns)

        for batch in batches:
            counts: dict[tuple[bytes, bytes], Counter] = {}
            for lang, source, text in rows_of(batch, "lang", "source", "text"):
                if lang in known.held:
                    counts.setdefault((lang, source), Counter()).update(split(text))
            for group, own in counts.items():
                size = known.size[group[0]]
                if group not in dense:
                    if dense and held + size > held_slots:
                        yield from filled()
                        dense, held = {}, 0
                    dense[group] = np.zeros(size, dtype=np.int64)
                    held += size
                at = known.slots(group[0], list(own))
                n = np.fromiter(own.values(), dtype=np.int64, count=len(own))
                dense[group][at[at >= 0]] += n[at >= 0]
        yield from filled()

    return rows.mapInArrow(count, "lang binary, source binary, shard int, slot int, count long")


# --- the report --------------------------------------------------------------------------------


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exact; NULL without terms."""
    over = F.nullif((total + ADDED * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    up = (F.lit(SCALE).cast("decimal(11,0)") * (count + ADDED).cast("decimal(20,0)")).cast("decimal(32,0)")
    return F.call_function("div", up, over).cast("long") + 1


def _apart(table: pa.Table) -> pa.Table:
    """Summed differences of every two sources of two blocks, over the slots of one shard of a language."""
    table = table.sort_by("slot")  # slot -1 leads: one row for each source, its share without occurrences
    coded = table["source"].combine_chunks().dictionary_encode()
    codes, p, slot = coded.indices.to_numpy(), table["p"].to_numpy(), table["slot"].to_numpy()
    heads = int((slot < 0).sum())
    at = np.empty(len(coded.dictionary), dtype=np.int64)
    at[codes[:heads]] = np.arange(heads)
    names = coded.dictionary.take(pa.array(codes[:heads])).to_pylist()
    base, side = p[:heads], table["b"].to_numpy()[:heads]
    terms = table["terms"][0].as_py()
    slots, column = np.unique(slot[heads:], return_inverse=True)
    shares = np.repeat(base[:, None], len(slots), axis=1)
    shares[at[codes[heads:]], column] = p[heads:]
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    out = []
    for i in np.flatnonzero(side == left):
        others = np.flatnonzero(side == right)
        others = others[others != i] if left == right else others
        # Slots that none of these sources fills differ by the empty shares alone.
        apart = np.abs(shares[others] - shares[i]).sum(axis=1) + (terms - len(slots)) * np.abs(base[others] - base[i])
        out += [(names[i], names[j], int(v)) for j, v in zip(others, apart)]
        if left != right:
            out += [(b, a, v) for a, b, v in out[len(out) - len(others) :]]
    columns = list(zip(*out)) if out else [()] * 3
    lang = [table["lang"][0].as_py()] * len(out)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("lang", "source", "item", "value"), (lang, *columns), (pa.binary(), pa.binary(), pa.binary(), pa.int64()))})


def audit(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    ranks: int = RANKS,
    volume_bytes: int = VOLUME_BYTES,
    shard_keys: int = SHARD_KEYS,
    held_slots: int = HELD_SLOTS,
    sources: int = SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source).

    Part ``pair`` ranks every other source of the language by the summed differences of their
    term shares, part ``term`` the ``ranks`` terms most over-represented against the language.
    Shares are whole billionths, smoothed by 5 occurrences of each kept term. Kept are the terms
    in at least ``least_docs`` rows of the language; repeated rows count as often as they
    occur. NULL text, language and source count as ''; a group without terms takes part, with
    0 occurrences; a language without kept terms has pairs of value 0. An empty table has no
    rows. Values descend, ties are broken by the item in UTF-8 order.
    """
    none = F.lit("")
    rows = only(docs, text=text, lang=lang, source=source).select(*(F.coalesce(F.col(c).cast("string"), none).cast("binary").alias(c) for c in ("text", "lang", "source")))
    kept = cut_lineage(_document_counts(rows).where(F.col("docs") >= least_docs).select("lang", "term"))
    hashed = cut_lineage(_hashed(kept, shard_keys))
    counted = [_recount(rows, volume, held_slots) for volume in _volumes(hashed, volume_bytes)]
    cells = cut_lineage(reduce(DataFrame.unionAll, counted).groupBy("lang", "source", "shard", "slot").agg(F.sum("count").alias("count")))

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = cut_lineage(
        rows.select("lang", "source")
        .distinct()
        .join(cells.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    )
    shared = cells.join(groups, ["lang", "source"]).select("lang", "source", "shard", "slot", "count", _share(F.col("count"), F.col("n"), F.col("v")).alias("p"))
    pairs = _pairs(groups, shared, hashed, sources)
    terms = _terms(groups, shared, hashed, ranks)
    # Every language, source and item is text again.
    out = pairs.unionByName(terms)
    return out.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source")), "part", F.col("item").cast("string").alias("item"), "value", "rank")


def _ranks(df: DataFrame, part: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))


def _pairs(groups: DataFrame, shared: DataFrame, hashed: DataFrame, sources: int) -> DataFrame:
    """The report holds every pair of a language's sources, so sources meet in blocks."""
    many = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s")).select("lang", F.ceil(F.col("s") / sources).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "b").alias("left"), F.greatest(x, "b").alias("right"))))
    terms = hashed.select("lang", "shard", F.size("terms").cast("long").alias("terms"))
    # A language without kept terms has one shard of none, so that its pairs are there with 0.
    heads = (
        groups.join(terms, "lang", "left")
        .select("lang", "source", F.coalesce("shard", F.lit(-1)).alias("shard"), F.lit(-1).alias("slot"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), _share(F.lit(0), F.col("n"), F.col("v")).alias("p"))
        .withColumn("p", F.coalesce("p", F.lit(0)))
    )
    filled = shared.select("lang", "source", "shard", "slot", F.lit(0).cast("long").alias("terms"), "p")
    dealt = heads.unionByName(filled).join(many, "lang").withColumn("b", block).withColumn("x", meet)
    placed = dealt.select("lang", "shard", "x.left", "x.right", "b", "source", "slot", "p", "terms")
    apart = placed.groupBy("lang", "shard", "left", "right").applyInArrow(_apart, "lang binary, source binary, item binary, value long")
    return _ranks(apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def _terms(groups: DataFrame, shared: DataFrame, hashed: DataFrame, ranks: int) -> DataFrame:
    whole = groups.groupBy("lang").agg(F.sum("n").alias("ln"), F.first("v").alias("lv"))
    of_lang = shared.groupBy("lang", "shard", "slot").agg(F.sum("count").alias("lcount")).join(whole, "lang")
    usual = of_lang.select("lang", "shard", "slot", _share(F.col("lcount"), F.col("ln"), F.col("lv")).alias("q"))
    over = shared.join(usual, ["lang", "shard", "slot"]).where("p > q").select("lang", "source", "shard", "slot", (F.col("p") - F.col("q")).alias("value"))
    names = hashed.select("lang", "shard", F.posexplode("terms").alias("slot", "item"))
    return _ranks(over.join(names, ["lang", "shard", "slot"]), "term").where(F.col("rank") <= ranks)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
spread AS (SELECT r, lang, source, unnest(ts) AS t FROM docs),
kept AS (SELECT lang, t FROM spread GROUP BY lang, t HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT s.lang, s.source, s.t, count(*) AS c FROM spread s JOIN kept k ON s.lang = k.lang AND s.t = k.t GROUP BY ALL),
names AS (SELECT DISTINCT lang, source FROM docs),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM names g LEFT JOIN cells c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.t, coalesce(c.c, 0) AS c,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // (g.n + 5 * z.v) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes z ON z.lang = g.lang
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
totals AS (SELECT lang, sum(n) AS n FROM groups GROUP BY lang),
usual AS (
  SELECT d.lang, d.t, 1 + (CAST(1000000000 AS HUGEINT) * (sum(d.c) + 5)) // (any_value(o.n) + 5 * any_value(z.v)) AS q
  FROM dense d JOIN totals o ON o.lang = d.lang JOIN sizes z ON z.lang = d.lang GROUP BY d.lang, d.t),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT d.lang, d.source, 'term', d.t, d.p - u.q FROM dense d JOIN usual u ON d.lang = u.lang AND d.t = u.t
  WHERE d.c > 0 AND d.p > u.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

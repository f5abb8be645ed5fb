"""Ranked lexical search: documents as paths of a frequency-ordered tree, searched by bounds.

Every document is restricted to the terms of the items and written as (term, tf) in the order
of descending document frequency, so that documents share the beginnings of their paths. A
node knows the greatest tf of each term and the least length measure m below it: no document
under it can score more than those would. Items are searched depth first, and an item leaves
a subtree whose bound stays under its k-th best score.

The order, the weights and the scores are those of the whole table: statistics come first,
then one tree is built for each bounded run of documents, and the best of all trees are ranked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotflow.llm.common import only
from slotflow.llm.words import Words, part_count, rows_of
from slotflow.session import cut_lineage

SCALE = 1_000_000_000
#: Items searched together: about so many, with about so many bytes of text.
ITEMS, ITEM_BYTES = 1024, 1 << 22
TREE, CELLS = 2048, 1 << 24  # most documents of one tree, and most cells (documents x terms) of its maxima
LEAF = 16  # documents below which a node is not divided further
DEPTH = 64  # terms of a path that the tree divides by; bounds always cover all terms
#: One document in so many is searched first: its k-th best score is a floor for all others.
FLOOR_SHARE = 64


def top_documents(
    docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", k: int = 50
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Equal scores rank by ascending key, rows without a key last. NULL, empty and wordless texts
    of either table take no part; N, L, n and df are those of whole texts of all rows. Every row
    is a document, and every item row an item, also with repeated keys or texts. Items are
    searched in blocks of bounded size, each against all documents.
    """
    known = only(items, item=item_key, text=item_text).withColumn("text", F.col("text").cast("binary"))
    blocks = max(part_count(known, F.lit(1), ITEMS), part_count(known, F.octet_length("text"), ITEM_BYTES))
    # Rows of one (key, text) share a block, where they are told apart by their number.
    dealt = known.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    rows = only(docs, key=key, text=text).select(F.col("key").cast("long"), F.col("text").cast("binary"))
    found = []
    for block in range(blocks):
        # About ITEMS rows and ITEM_BYTES: all that reaches the driver at once.
        held = dealt.where(F.col("block") == block).select("item", "text").collect()
        found.append(_block(rows, [(r["item"], bytes(r["text"] or b"")) for r in held], dict(items.dtypes)[item_key], k))
    return reduce(DataFrame.unionAll, found)


def _block(rows: DataFrame, items: list[tuple], kind: str, k: int) -> DataFrame:
    spark, split = rows.sparkSession, Words(digits=True)
    items = sorted(items, key=lambda x: (x[0] is None, str(x[0]), x[1]))
    terms = [sorted(set(split(text))) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
    vectors = cut_lineage(_vectors(rows, vocabulary))
    n, total = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    stats = vectors.select(F.explode("terms").alias("t")).groupBy("t").count()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for row in stats.collect():  # one row for each term of the items
        df[row["t"]] = row["count"]
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(items)], f"item int, item_id {kind}")
    held = vectors.where(F.size("terms") > 0)
    m = F.expr(f"50 + cast((cast(50 as decimal(20,0)) * n * cast({n}L as decimal(18,0))) div {total or 1}L as bigint)")
    measured = held.select("key", "terms", "tfs", m.alias("m"))
    plan = Plan.of([[vocabulary[t] for t in own] for own in terms], df, n, k)
    first = _ranked(_searched(measured.where(F.pmod(F.xxhash64("key", "terms", "m"), F.lit(FLOOR_SHARE)) == 0), plan), k)
    floors = np.ones(len(items), dtype=np.int64)
    for row in first.where(F.col("rank") == k).select("item", "score").collect():  # at most one for each item
        floors[row["item"]] = row["score"]
    best = _ranked(_searched(measured, plan.above(floors)), k)
    return best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("key").alias("doc_id"), "score")


def _vectors(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, tfs) of every document with a term: n counts all its terms, the lists those of the items."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = Words(digits=True), sent.value
        for batch in batches:
            keys, sizes, terms, tfs = [], [], [], []
            for key, text in rows_of(batch, "key", "text"):
                words = split(text)
                if words:
                    counts = Counter(words)
                    own = [w for w in counts if w in known]
                    keys.append(key)
                    sizes.append(len(words))
                    terms.append([known[w] for w in own])
                    tfs.append([counts[w] for w in own])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, sizes, terms, tfs), kinds)], ["key", "n", "terms", "tfs"])

    return rows.mapInArrow(restrict, "key long, n long, terms array<int>, tfs array<long>")


@dataclass(frozen=True)
class Plan:
    """Items with terms, as places in the order of descending document frequency, and their floors."""

    item: np.ndarray  # number of each searched item
    flat: np.ndarray  # places of the terms of all searched items
    begin: np.ndarray  # where each item starts in ``flat``
    place: np.ndarray  # term -> place
    weight: np.ndarray  # place -> weight
    floor: np.ndarray  # least score that counts, of each searched item
    k: int

    @staticmethod
    def of(terms: list[list[int]], df: np.ndarray, n: int, k: int) -> Plan:
        order = np.lexsort((np.arange(len(df)), -df))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df[order].tolist()], dtype=np.int64)
        item = np.array([i for i, own in enumerate(terms) if own], dtype=np.int64)
        sizes = [len(terms[i]) for i in item]
        flat = place[np.array([t for i in item for t in terms[i]], dtype=np.int64)] if len(item) else np.array([], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(item) else flat
        return Plan(item, flat, begin, place, weight, np.ones(len(item), dtype=np.int64), k)

    def above(self, floors: np.ndarray) -> Plan:
        return Plan(self.item, self.flat, self.begin, self.place, self.weight, floors[self.item], self.k)

    def sums(self, worth: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Sums over the terms of the open items, for each row of ``worth`` (rows x places)."""
        sizes = np.diff(np.append(self.begin, len(self.flat)))[open_]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(self.begin[open_] - begin, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(worth[:, self.flat[at]], begin, axis=1)

    def worth(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What each term adds: rises with tf and falls with m."""
        return self.weight * ((SCALE * tf) // np.maximum(1000 * tf + 20 * m[:, None], 1))


class Tree:
    """The tree of a run of documents: nodes are ranges of documents in the order of their paths."""

    def __init__(self, docs: list[tuple], width: int) -> None:
        """``docs``: (places, tfs, m, keys) with different (places, tfs, m), the places ascending."""
        depth = max(1, min(DEPTH, max(len(d[0]) for d in docs)))
        paths = np.full((len(docs), depth), -1, dtype=np.int32)
        for i, doc in enumerate(docs):
            own = doc[0][:depth]
            paths[i, : len(own)] = own
        order = np.lexsort(paths.T[::-1])
        self.docs, self.paths = [docs[i] for i in order], paths[order]
        self.m = np.array([d[2] for d in self.docs], dtype=np.int64)
        self.width = width
        #: (children, greatest tf of each place, least m, first document, document after the last)
        self.root = self._node(0, len(self.docs), 0)

    def dense(self, begin: int, end: int) -> np.ndarray:
        tf = np.zeros((end - begin, self.width), dtype=np.int64)
        for i in range(begin, end):
            places, tfs = self.docs[i][:2]
            tf[i - begin, places] = tfs
        return tf

    def _node(self, begin: int, end: int, depth: int) -> tuple:
        children = []
        # A path that no document leaves is one step.
        while depth < self.paths.shape[1] and self.paths[begin, depth] == self.paths[end - 1, depth] >= 0:
            depth += 1
        if end - begin > LEAF and depth < self.paths.shape[1]:
            column = self.paths[begin:end, depth]
            cuts = [begin, *(begin + 1 + np.flatnonzero(np.diff(column))).tolist(), end]
            children = [self._node(a, b, depth + 1) for a, b in zip(cuts, cuts[1:])]
        elif end - begin > LEAF:
            children = [self._node_of(a, min(a + LEAF, end), []) for a in range(begin, end, LEAF)]
        return self._node_of(begin, end, children)

    def _node_of(self, begin: int, end: int, children: list[tuple]) -> tuple:
        if children:
            most = reduce(np.maximum, (c[1] for c in children))
        else:
            most = self.dense(begin, end).max(axis=0)
        return children, most.astype(np.int32) if most.max(initial=0) < 2**31 else most, self.m[begin:end].min(), begin, end


class Best:
    """The k best documents of each item so far: matrices in which a row is an item."""

    def __init__(self, plan: Plan) -> None:
        self.plan, self.floor = plan, plan.floor.copy()
        self.high = np.zeros((len(plan.item), plan.k), dtype=np.int64)  # k highest scores, ascending
        self.rows: list[tuple] = []  # (item, score, keys)

    def search(self, tree: Tree) -> None:
        plan = self.plan
        stack = [self._way(tree.root, np.arange(len(plan.item)))]
        while stack:
            bounds, open_, (children, _, _, begin, end) = stack.pop()
            open_ = open_[bounds >= self.floor[open_]]  # floors may have risen since the bound was made
            if len(open_) and children:
                # The most promising child is searched first: it raises the floors for the others.
                stack += sorted((self._way(child, open_) for child in children), key=lambda way: float(way[0].sum()))
            elif len(open_):
                self._leaf(tree, begin, end, open_)
        self._cut()

    def _way(self, node: tuple, open_: np.ndarray) -> tuple:
        """(bounds, items, node): no document below scores more than the greatest tf with the least m."""
        worth = self.plan.worth(node[1][None, :].astype(np.int64), np.array([node[2]]))
        return self.plan.sums(worth, open_)[0], open_, node

    def _leaf(self, tree: Tree, begin: int, end: int, open_: np.ndarray) -> None:
        scores = self.plan.sums(self.plan.worth(tree.dense(begin, end), tree.m[begin:end]), open_)
        fit = scores >= self.floor[open_]
        for at, j in zip(*np.nonzero(fit)):
            self.rows.append((int(open_[j]), int(scores[at, j]), tree.docs[begin + at][3]))
        # Copies count as often as they occur, but k times at most.
        times = [min(len(tree.docs[i][3]), self.plan.k) for i in range(begin, end)]
        new = np.repeat(np.where(fit, scores, 0), times, axis=0).T
        k = self.plan.k
        merged = np.concatenate([self.high[open_], new], axis=1)
        self.high[open_] = np.sort(merged, axis=1)[:, -k:]
        self.floor[open_] = np.maximum(self.floor[open_], self.high[open_, 0])

    def _cut(self) -> None:
        """Keep of each item the k best rows alone: by score, then by key, rows without a key last."""
        held: dict[int, list[tuple]] = {}
        for item, score, keys in self.rows:
            if score >= self.floor[item]:
                held.setdefault(item, []).extend((-score, key is None, key or 0, key) for key in keys)
        self.rows = [(item, -x[0], [x[3]]) for item, found in held.items() for x in sorted(found, key=lambda x: x[:3])[: self.plan.k]]


def _trees(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[Tree]:
    """Trees of a bounded number of different documents; copies of a vector are one document with all their keys."""
    held: dict[tuple, list] = {}
    most = min(TREE, max(LEAF, CELLS // len(plan.place)))

    def tree() -> Tree:
        docs = [(np.frombuffer(p, np.int64), np.frombuffer(t, np.int64), m, sorted(keys, key=lambda x: (x is None, x or 0))[: plan.k]) for (p, t, m), keys in held.items()]
        return Tree(docs, len(plan.place))

    for batch in batches:
        for key, terms, tfs, m in rows_of(batch, "key", "terms", "tfs", "m"):
            places = plan.place[np.array(terms, dtype=np.int64)]
            order = np.argsort(places)
            path = (places[order].astype(np.int64).tobytes(), np.array(tfs, dtype=np.int64)[order].tobytes(), m)
            keys = held.setdefault(path, [])
            keys.append(key)
            if len(keys) >= 4 * plan.k:  # of equal documents an item ranks the k smallest keys at most
                keys[:] = sorted(keys, key=lambda x: (x is None, x or 0))[: plan.k]
            if len(held) >= most:
                yield tree()
                held = {}
    if held:
        yield tree()


def _searched(measured: DataFrame, plan: Plan) -> DataFrame:
    """(item, score, key): the k best documents of each item in every partition."""
    sent = measured.sparkSession.sparkContext.broadcast(vars(plan))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Plan(**sent.value)
        best = Best(own)
        if len(own.item):
            for tree in _trees(batches, own):
                best.search(tree)
        rows = [(int(own.item[item]), score, keys[0]) for item, score, keys in best.rows]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "score", "key"])

    return measured.mapInArrow(search, "item int, score long, key long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
items AS (SELECT row_number() OVER () AS r, item_id, {_TERMS} AS ts FROM benchmark),
sizes AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM docs WHERE len(ts) > 0),
tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) GROUP BY r, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, sizes GROUP BY t, n_docs),
measures AS (SELECT r, doc_id, 50 + (50 * CAST(len(ts) AS HUGEINT) * n_docs) // n_terms AS m FROM docs, sizes WHERE len(ts) > 0),
wanted AS (SELECT DISTINCT r, item_id, t FROM (SELECT r, item_id, unnest(ts) AS t FROM items)),
scored AS (
  SELECT q.r, q.item_id, d.r AS d, d.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * d.m))) AS score
  FROM wanted q JOIN weights w ON q.t = w.t JOIN tfs f ON f.t = q.t JOIN measures d ON d.r = f.r
  GROUP BY q.r, q.item_id, d.r, d.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
"""

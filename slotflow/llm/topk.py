"""Exact top-k by integer inner product: norm-sorted candidates, pruned by residual bounds.

Vectors become integers floor(scale * x). Candidates are cut into blocks by descending length
over the whole table, and the k-th best score against the longest ones gives every query a
floor: a query is only sent to the blocks whose greatest length times its own reaches it. In
a block too, a query leaves when its length times the next candidate's is below its k-th
best score. Before exact products, vectors rotated to the singular directions of a sample give
a partial sum over the leading ones; by Cauchy-Schwarz the rest adds at most the product of
the residual lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotflow.llm.common import only
from slotflow.session import cut_lineage

_FOUND = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Search:
    """k, and sizes that bound what a task holds; they do not change the result."""

    k: int = 5
    candidates: int = 16_384  # rows of a candidate block
    queries: int = 8_192  # rows of a query group
    cells: int = 1 << 22  # components of a block or group: wide vectors make shorter ones
    seeds: int = 1024  # longest candidates, which give every query its first bound
    sample: int = 4096  # rows that fit the rotation
    leading: int = 16  # rotated dimensions of the partial sum

    def rows(self, most: int, width: int) -> int:
        return max(1, min(most, self.cells // width))


def integers(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v, norm): floor(scale * x) of every vector that takes part, as longs, one row for each row.

    Vectors that are NULL or hold a NULL or non-finite component, and rows without an id, take
    no part. A component beyond 2**63 fails.
    """
    rows = only(vectors, id=key, v=vector).select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fits = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x * scale))) < F.lit(9.2e18), F.lit(True))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component does not fit into a long")).cast("array<long>"))
    held = rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).select("id", checked.alias("v"))
    return held.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))


def top_k(vectors: DataFrame, is_query: Column, how: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates, equal scores by smaller id.

    ``vectors`` is what :func:`integers` gives; ``is_query`` is a condition on its ``id``. Every
    row of another id is a candidate of a query, also where ids repeat; query rows of one id are
    one query, which takes the best of their pairs. Vectors of different lengths are compared as
    if the shorter went on with zeros. Fewer candidates than k: all of them. A best score that
    does not fit into a long fails.
    """
    held = cut_lineage(vectors)
    width = max(1, held.agg(F.max(F.size("v"))).first()[0] or 1)
    sample = held.orderBy(F.xxhash64("id"), "id").limit(how.sample).select("v").collect()
    turn = rotation(_matrix([r.v for r in sample], width).astype(float))
    asked, dealt = deal(held, is_query, width, turn, how)
    found = _searched(asked, dealt, ["g", "b"], turn, width, how)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")


def deal(held: DataFrame, is_query: Column, width: int, turn: np.ndarray, how: Search) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates, each once for every (group, block) that they have to meet in.

    Blocks descend by length, groups by how many blocks their queries reach: both meet in
    leading runs of the other, known by one number.
    """
    blocks, tops = _ranges(held, "norm", how.rows(how.candidates, width), "b")
    queries = held.where(is_query)
    hashed = queries.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, math.ceil(queries.count() / how.rows(how.queries, width))))).cast("int"))
    groups = hashed.agg(F.max("g")).first()[0] or 0
    seeds = held.orderBy(F.desc("norm"), "id").limit(how.seeds).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(groups))).alias("g"))
    first = _searched(hashed.select("id", "v", "g", F.lit(None).cast("long").alias("floor")), seeds, ["g"], turn, width, how)
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= how.k)
    floors = floors.select(F.col("query_id").alias("id"), F.col("low").alias("floor"))
    reaching = queries.join(floors, "id", "left").withColumn("reach", _reach(F.col("norm"), F.col("floor"), tops))
    grouped, reaches = _ranges(reaching, "reach", how.rows(how.queries, width), "g")
    asked = grouped.where("reach > 0").select("id", "v", "g", "floor", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("b"))
    meets = _reach(F.lit(1.0), (F.col("b") + 1).cast("long"), reaches)  # groups that reach beyond block b
    dealt = blocks.withColumn("meets", meets).where("meets > 0").select("id", "v", "b", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("g"))
    return asked, dealt


def _ranges(rows: DataFrame, by: str, most: int, out: str) -> tuple[DataFrame, list[float]]:
    """The rows with the number ``out`` of their range by descending ``by``, and the greatest value of each range.

    One number for about ``most`` rows reaches the driver.
    """
    n = math.ceil(rows.count() / most)
    if n <= 1:
        ranged = cut_lineage(rows.withColumn(out, F.lit(0)))
    else:
        ranged = cut_lineage(rows.repartitionByRange(n, F.desc(by), F.xxhash64("id", "v")).withColumn(out, F.spark_partition_id()))
    tops = {r[out]: r["top"] for r in ranged.groupBy(out).agg(F.max(by).alias("top")).collect()}
    values, last = [], math.inf
    for i in range(max(tops, default=-1) + 1):
        last = tops.get(i, last)
        values.append(float(last))
    return ranged, values


def _reach(norm: Column, floor: Column, tops: list[float]) -> Column:
    """How many of the leading ranges may hold a score of at least ``floor`` (NULL: all of them)."""

    @F.arrow_udf("int")
    def reach(norms: pa.Array, floors: pa.Array) -> pa.Array:
        least = np.array([-math.inf if x is None else x for x in floors.to_pylist()], dtype=float)
        own = norms.to_numpy(zero_copy_only=False)
        out = np.zeros(len(own), dtype=np.int32)
        descending = np.array(tops)
        for i, (n, low) in enumerate(zip(own, least)):
            bound = n * descending
            out[i] = len(tops) - np.searchsorted((bound + _slack(bound))[::-1], low)
        return pa.array(out, pa.int32())

    return reach(norm.cast("double"), floor.cast("double"))


def _slack(bound):
    """What rounding may take from a bound; more than all scores are apart only beyond 2**30 times it."""
    return 1e-6 + 1e-9 * np.abs(bound)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose leading columns carry most of the sample; exactness does not depend on it."""
    if not len(sample):
        return np.eye(sample.shape[1])
    return np.linalg.svd(sample.T @ sample)[0]


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _searched(queries: DataFrame, candidates: DataFrame, by: list[str], turn: np.ndarray, width: int, how: Search) -> DataFrame:
    """Best candidates of each (query block, candidate block), at most k for a query."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = [np.array([], dtype=np.int64)] * 3
        else:
            q_ids, c_ids = left["id"].to_numpy(), right["c_id"].to_numpy()
            found = best(q_ids, _vectors(left["v"], width), left["floor"].to_pylist(), c_ids, _vectors(right["c_v"], width), turn, how)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    # Both sides come from one table: own names keep them apart. Keys have one type, so that
    # equal ones are dealt alike.
    other = candidates.select(*(F.col(c).alias(f"c_{c}") for c in ("id", "v", *by)))
    return queries.groupBy(*by).cogroup(other.groupBy(*(f"c_{c}" for c in by))).applyInArrow(search, _FOUND)


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    if (sizes == width).all():
        return flat.flatten().to_numpy().reshape(-1, width)
    return _matrix(flat.to_pylist(), width)


def _products(q: np.ndarray, i: np.ndarray, c: np.ndarray, j: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Exact inner products of the rows ``i`` of q and ``j`` of c, a bounded number of them at once."""
    return np.concatenate([np.einsum("ij,ij->i", q[i[s : s + step]], c[j[s : s + step]]) for s in range(0, len(i), step)] or [np.array([], dtype=np.int64)])


def best(q_ids, q, floor, c_ids, c, turn, how: Search) -> list[np.ndarray]:
    """The at most k best pairs of every query at or above its floor: (query ids, candidate ids, scores)."""
    qf, cf = q.astype(float), c.astype(float)
    length, q_norm = np.linalg.norm(cf, axis=1), np.linalg.norm(qf, axis=1)
    if q_norm.max() * length.max() >= 2.0**62:
        return _best_of_large(q_ids, q, c_ids, c, how)
    order = np.lexsort((c_ids, -length))
    c_ids, c, cf, c_norm = c_ids[order], c[order], cf[order], length[order]
    h = min(how.leading, q.shape[1])
    qr, cr = qf @ turn, cf @ turn
    q_rest, c_rest = np.linalg.norm(qr[:, h:], axis=1), np.linalg.norm(cr[:, h:], axis=1)
    low = np.array([-(1 << 62) if f is None else f for f in floor], dtype=np.int64)
    chunk = max(128, (1 << 19) // len(q))  # bounds of so many pairs at once
    empty = np.array([], dtype=np.int64)
    top = [empty, empty, empty]  # query row, candidate id, score
    for at in range(0, len(c), chunk):
        limit = q_norm * c_norm[at]
        open_ = np.flatnonzero(limit + _slack(limit) >= low)  # lengths descend: others are done
        if not len(open_):
            break
        part = slice(at, at + chunk)
        bound = qr[open_, :h] @ cr[part, :h].T + np.outer(q_rest[open_], c_rest[part])
        i, j = np.nonzero(bound + _slack(limit)[open_, None] >= low[open_, None])
        i, j = open_[i], j + at
        other = q_ids[i] != c_ids[j]
        i, j = i[other], j[other]
        score = _products(q, i, c, j)
        fit = score >= low[i]
        rows = [np.concatenate(x) for x in zip(top, (i[fit], c_ids[j[fit]], score[fit]))]
        order = np.lexsort((rows[1], -rows[2], rows[0]))
        rows = [x[order] for x in rows]
        nth = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        top = [x[nth < how.k] for x in rows]
        full = nth == how.k - 1
        low[rows[0][full]] = np.maximum(low[rows[0][full]], rows[2][full])
    return [q_ids[top[0]].astype(np.int64), top[1], top[2]]


def _best_of_large(q_ids, q, c_ids, c, how: Search) -> list[np.ndarray]:
    """The same where products may not fit into longs: in Python's integers, pair by pair."""
    found = []
    for key, u in zip(q_ids.tolist(), q.tolist()):
        scored = sorted((-sum(x * y for x, y in zip(u, v)), k) for k, v in zip(c_ids.tolist(), c.tolist()) if k != key)[: how.k]
        found += [(key, k, -s) for s, k in scored]
    if any(abs(s) >= 1 << 63 for *_, s in found):
        raise OverflowError("a best score does not fit into a long")
    return [np.array(x, dtype=np.int64) for x in (zip(*found) if found else ([], [], []))]


SQL = """
WITH fit AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

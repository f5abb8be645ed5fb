"""Embedding near-dedup and exact top-k against brute force."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slotflow.llm import covertree, queries, topk
from tests.llm.test_dedup_packing import roots
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    fit = {}
    for key, v, label in rows:
        if key is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, dtype=np.float64)
            fit[key] = (label, u / np.linalg.norm(u))
    keys = sorted(fit)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if fit[a][0] == fit[b][0] and len(fit[a][1]) == len(fit[b][1]) and fit[a][1] @ fit[b][1] >= least]
    top = roots(keys, links)
    count = {k: 0 for k in keys}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {r[0]: (count.get(r[0], 0), top.get(r[0], r[0]), top.get(r[0], r[0]) == r[0]) for r in rows if r[0] is not None}


def clustered(seed, n, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        spread = rng.choice([0.02, 0.05, 0.1, 0.4])
        v = centres[rng.integers(12)] + spread * rng.normal(size=width)
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([0.5, 1.0, 3.0])], int(rng.integers(2))))
    rows += [(n + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]
    return rows


ODD = [
    (9001, None, 1),
    (9002, [], 1),
    (9003, [0.0] * 8, 1),
    (9004, [1.0, None] + [0.0] * 6, 1),
    (9005, [float("nan")] + [1.0] * 7, 1),
    (9006, [float("inf")] + [1.0] * 7, 1),
    (9007, [1.0] * 8, None),
    (9008, [1.0] * 8, None),
    (9009, [1.0] * 3, 1),
    (9010, [1e30] * 8, 1),
    (9011, [1e-30] * 8, 1),
]


@pytest.mark.parametrize("cells", [covertree.Cells(), covertree.Cells(cell=40, chunk=32, visitors=100)])
def test_near_duplicates_against_all_pairs(spark, cells):
    rows = clustered(1, 500) + ODD
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", node string, kept int")
    got = covertree.near_duplicates(frame, cells=cells).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_given_embeddings(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op5_embedding_neardup(spark, SF).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def brute_rows(rows, least=0.98):
    """Row by row, for keys that repeat: counts per row, components over keys."""
    unit = [None if v is None or not any(v) else np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= least]
    top = roots({r[0] for r in rows}, [(rows[i][0], rows[j][0]) for i, j in near if rows[i][0] != rows[j][0]])
    count = np.bincount([k for pair in near for k in pair], minlength=len(rows))
    return sorted((r[0], int(n), top[r[0]]) for r, n in zip(rows, count))


def test_repeated_keys_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.01, 1.0, 0.0], 1), (4, [0.0, 0.0, 1.0], 1), (4, [0.0, 0.0, 1.0], 1)]
    rng = np.random.default_rng(3)
    rows += [(int(rng.integers(10, 40)), (np.eye(3)[rng.integers(3)] + 0.1 * rng.normal(size=3)).tolist(), 1) for _ in range(150)]
    got = covertree.near_duplicates(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), cells=covertree.Cells(cell=20, chunk=16, visitors=30)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_rows(rows)


def test_trees_measure_less_than_half_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=1500)] + 0.15 * rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    measured, plain = [], covertree._cosines
    monkeypatch.setattr(covertree, "_cosines", lambda a, b: (measured.append(len(a) * len(b)), plain(a, b))[1])
    tree = covertree.CoverTree(x)
    i, j = covertree.near_pairs(tree, tree, 0.98)
    want = np.triu(x @ x.T >= 0.98, 1)
    assert len(i) == want.sum() > 500 and want[i, j].all()
    assert sum(measured) < len(x) * (len(x) - 1) / 4


def test_rows_without_key_and_none_at_all(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(frame).collect()}
    assert got == {None: (0, None, False), 3: (0, 3, True)}
    assert covertree.near_duplicates(frame.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_dual_traversal(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(60, 4)), np.repeat(rng.normal(size=(3, 4)), 40, axis=0) + 0.03 * rng.normal(size=(120, 4))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[rng.permutation(len(x))[:90]]
    for least in (0.9, 0.98, 0.999):
        i, j = covertree.near_pairs(covertree.CoverTree(x), covertree.CoverTree(y), least)
        want = set(zip(*(a.tolist() for a in np.nonzero(x @ y.T >= least))))
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def brute_top(rows, k=5):
    """Every row counts; rows of the query's id are no candidates, and query rows of one id are one query."""
    fit = [(r[0], [int(np.floor(256 * x)) for x in np.array(r[1], dtype=np.float64)]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for q in {key for key, _ in fit if key % 50 == 0}:
        pairs = [(-sum(x * y for x, y in zip(u, v)), c) for key, u in fit if key == q for c, v in fit if c != q]
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(pairs)[:k])]
    return sorted(out)


@pytest.mark.parametrize("how", [topk.Search(), topk.Search(candidates=64, queries=4, seeds=16, sample=50, leading=3)])
def test_top_k_against_all_pairs(spark, how):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 1) for i in range(400)] + [(500 + i, [0.1] * 8, 1) for i in range(60)] + [(700, [0.0] * 8, 1), (750, [], 1), (751, [2.0, 1.0], 1)]
    rows += [(800, None, 1), (801, [None] * 8, 1), (850, [float("nan")] * 8, 1), (900, [float("-inf")] * 8, 1), (None, [1.0] * 8, 1), (1, rows[1][1], 1)]
    # repeated ids: a better candidate, a copy, and another vector of a query
    rows += [(3, [9.0] * 8, 1), (3, [9.0] * 8, 1), (100, [-2.0] * 8, 1), (100, rows[100][1], 1)]
    # integers whose scores no double tells apart
    rows += [(950, [2.0**20 + 1] * 8, 1), (951, [2.0**20] * 7 + [2.0**20 + 1 / 256], 1), (952, [2.0**20] * 8, 1)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA.replace("float", "double") + ", score int")
    # Blocks in partitions of their own, as a large table has them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = topk.top_k(topk.integers(frame), F.col("id") % 50 == 0, how).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in got) == brute_top(rows)


def test_top_k_of_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 1), (7, [1.0, -2.0], 1)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(topk.integers(frame), F.col("id") % 50 == 0).collect()] == [(0, 1, 7, 256 * 256 - 512 * 512)]
    assert topk.top_k(topk.integers(frame.limit(0)), F.col("id") % 50 == 0).collect() == []


def test_scores_beyond_doubles(spark):
    big = [(50, [2.0**22, 1 / 256], 1), (1, [2.0**22, 1 / 256], 1), (2, [2.0**22, 0.0], 1), (3, [2.0**22, 2 / 256], 1)]
    assert [tuple(r) for r in topk.top_k(topk.integers(spark.createDataFrame(big, SCHEMA.replace("float", "double"))), F.col("id") % 50 == 0).collect()] == [
        (50, 1, 3, 2**60 + 2),
        (50, 2, 1, 2**60 + 1),
        (50, 3, 2, 2**60),
    ]
    for far in ([2.0**25, 0.0], [1e18, 0.0]):
        frame = spark.createDataFrame([(50, far, 1), (1, far, 1)], SCHEMA.replace("float", "double"))
        with pytest.raises(Exception, match="does not fit"):
            topk.top_k(topk.integers(frame), F.col("id") % 50 == 0).collect()


def test_copies_grow_slower_than_the_rows(spark):
    how = topk.Search(candidates=100, queries=50, seeds=64, sample=100)
    copies = []
    for n in (1000, 4000):
        rng = np.random.default_rng(7)
        lengths = np.exp(rng.normal(size=n))
        unit = rng.normal(size=(n, 6))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        rows = [(i, (u * s).tolist(), 1) for i, (u, s) in enumerate(zip(unit, lengths))]
        held = topk.integers(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).checkpoint()
        asked, dealt = topk.deal(held, F.col("id") % 10 == 0, 6, np.eye(6), how)
        copies.append((asked.count() + dealt.count()) / n)
        got = topk.top_k(held, F.col("id") % 10 == 0, how)
        assert got.count() == n // 10 * 5
    assert copies[1] < 2 * copies[0]  # four times the rows


def test_top_k_like_sql(spark):
    assert compare(spark, connect(SF), "op8", queries.op8_topk_inner_product, topk.SQL, SF) == []


def test_top_k_of_repeated_ids_like_sql(spark, tmp_path):
    rows = [(i % 70, [((i * 7) % 11) / 3.0, (i % 5) - 2.0, 0.25 * (i % 3)], 1) for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(spark, con, "op8", queries.op8_topk_inner_product, topk.SQL, str(tmp_path)) == []

"""Bins, chunks and salts must not change a result: twins and invariances."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slotflow.checks.adapter import movements
from slotflow.functions import ordered
from slotflow.functions.ordered import band_sums, fill_forward, in_blocks, lowest_in_group, next_rows, running, running_number, value_stats
from slotflow.functions.times import MINUTE
from slotflow.operators import delays, influence, slots, tuner
from tests.test_goldens import frame

SF = "/root/testdata/sf0.001"
START = datetime(2024, 3, 2, 5, 0)


def random_rows(seed: int, n: int, minutes: int, keys: int = 2):
    rng = random.Random(seed)
    hot = lambda: 0 if rng.random() < 0.6 else rng.randrange(keys)
    return [
        {
            "flight_id": f"F{rng.randrange(n // 3 + 1)}",
            "carrier": rng.choice(["AI", "XX", None]),
            "tail_number": None if rng.random() < 0.1 else f"T{hot()}",
            "gate": None if rng.random() < 0.1 else f"G{hot()}",
            "sched_dep": None if rng.random() < 0.05 else START + timedelta(minutes=rng.randrange(minutes)),
            "sched_arr": START + timedelta(minutes=rng.randrange(minutes)),
            "dep_delay_min": None if rng.random() < 0.2 else float(rng.randrange(-10, 60)),
            "origin": rng.choice(["BOM", "DEL"]),
        }
        for _ in range(n)
    ]


@pytest.fixture(params=[1 << 20, 40], ids=["one block", "many blocks"])
def block_rows(request, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", request.param)
    monkeypatch.setattr(ordered, "TREE_BITS", 2 if request.param < 100 else 12)
    return request.param


@pytest.mark.parametrize("n", [1, 3])
def test_next_rows_equals_plain_lead(spark, block_rows, n):
    df = frame(spark, random_rows(n, 300, 400)).repartition(5).select("row_id", "tail_number", "sched_dep")
    got = next_rows(df, ["tail_number"], "sched_dep", ["row_id"], n)
    plain = Window.partitionBy("tail_number").orderBy(F.col("sched_dep").asc_nulls_last(), "row_id")
    want = df.select("row_id", F.array_compact(F.array(*[F.lead("row_id", i).over(plain) for i in range(1, n + 1)])).alias("w"))
    both = got.join(want, "row_id").select(F.transform("next_rows", lambda x: x["row_id"]).alias("g"), "w").collect()
    assert len(both) == 300 and all(r.g == r.w for r in both)


def hot_day(spark, n=600):
    """One gate, tail, carrier and slot that hold every row, at distinct microseconds."""
    rng = random.Random(9)
    when = [START + timedelta(microseconds=x) for x in rng.sample(range(250_000_000), n)]
    return frame(spark, [{"flight_id": f"F{i}", "carrier": "AI", "tail_number": "T", "gate": "G", "sched_dep": t, "sched_arr": t, "dep_delay_min": rng.random() * 60} for i, t in enumerate(when)])


def test_no_window_group_passes_the_block(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    df = hot_day(spark)
    sizes = []
    plain = ordered.in_blocks

    def watched(df, keys, order, rows=None):
        blocked, n = plain(df, keys, order, rows)
        sizes.append(blocked.groupBy(*keys, "__block").count().agg(F.max("count")).first()[0] or 0)
        return blocked, n

    want = sorted(map(str, influence.dependency_edges(df).collect()))
    before = delays.delay_propagation_analysis(df, 2, limit=None).orderBy("row_id").collect()
    windows = slots.best_time_to_operate_enhanced(df, kind="departure").collect()
    monkeypatch.setattr(ordered, "in_blocks", watched)
    assert sorted(map(str, influence.dependency_edges(df).collect())) == want and len(want) > 1500
    assert delays.delay_propagation_analysis(df, 2, limit=None).orderBy("row_id").count() == len(before) > 500
    assert slots.best_time_to_operate_enhanced(df, kind="departure").collect() == windows
    assert len(sizes) > 8 and max(sizes) <= 50
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 1 << 20)
    assert sorted(map(str, influence.dependency_edges(df).collect())) == want
    whole = delays.delay_propagation_analysis(df, 2, limit=None).orderBy("row_id").collect()
    for a, b in zip(before, whole):
        assert a.row_id == b.row_id and a.total_future_flights == b.total_future_flights
        assert a.affected_flights == b.affected_flights and abs(a.avg_delay_propagation - b.avg_delay_propagation) < 1e-9
    assert slots.best_time_to_operate_enhanced(df, kind="departure").collect() == windows


def test_blocks_hold_the_order(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 20)
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id"))
    blocked, n = in_blocks(df, ["k"], ["id"])
    rows = sorted((r["__block"], r.k, r.id) for r in blocked.collect())
    assert n == 30 and [r[1:] for r in rows] == sorted((i % 3, i) for i in range(300))


def test_running_sums_and_lowest(spark, block_rows):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(4)
    got = {r.i: r for r in running(df, ["k"], ["i"], {"u": F.col("v")}, {"d": F.col("v")}).collect()}
    strict = {r.i: r for r in running(df, ["k"], ["i"], {"u": F.col("v")}, {"d": F.col("v")}, strict=True).collect()}
    add = lambda xs: sum(x for x in xs if x is not None) if any(x is not None for x in xs) else None
    for k, i, v in rows:
        own = [(j, w) for kk, j, w in rows if kk == k]
        assert got[i].u == add([w for j, w in own if j <= i]) and got[i].d == add([w for j, w in own if j >= i])
        assert strict[i].u == add([w for j, w in own if j < i]) and strict[i].d == add([w for j, w in own if j > i])
    whole = {r.i: r.u for r in running(df, [], ["i"], {"u": F.col("i")}).collect()}
    assert whole == {i: i * (i + 1) // 2 for i in range(400)}
    low = {(r.k, r.i): r.nth for r in lowest_in_group(df, ["k"], ["v", "i"], 70, "nth").collect()}
    want = {}
    for key in ("a", "b", None):
        own = sorted((v is not None, v or 0, i) for k, i, v in rows if k == key)
        want |= {(key, i): n + 1 for n, (_, _, i) in enumerate(own[:70])}
    assert low == want


def test_fill_and_number_over_chunks(spark, block_rows):
    rng = random.Random(5)
    rows = [(i, i % 2, rng.choice([None, None, None, i]) if 60 < i < 200 or i > 420 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id bigint, k int, v int").withColumn("chunk", F.shiftright("row_id", 4))
    filled = fill_forward(df, ["k"], "v", "chunk", "row_id", "f", then_back=True).collect()
    forward = {r.row_id: r.f for r in fill_forward(df, ["k"], "v", "chunk", "row_id", "f").collect()}
    last, first = {}, {k: next(v for _, kk, v in rows if kk == k and v is not None) for k in (0, 1)}
    want = {}
    for i, k, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert forward == want
    assert {r.row_id: r.f for r in filled} == {i: first[i % 2] if v is None else v for i, v in want.items()}
    numbered = running_number(df, ["k"], bits=4).collect()
    assert all(r.occurrence == r.row_id // 2 for r in numbered)


@pytest.mark.parametrize("low,high", [(1, 7200), (-21600, -7200), (7200, 21600), (0, 0), (-3, 2)])
def test_band_sums_equal_brute_force(spark, block_rows, low, high):
    rng = random.Random(low + high)
    points = [(rng.choice("ab"), rng.randrange(0, 40000) * rng.choice([1, 60]), rng.random()) for _ in range(400)]
    df = spark.createDataFrame(points, "k string, t bigint, v double")
    got = band_sums(df, ["k"], "t", low, high, {"n": F.lit(1), "s": F.col("v")}, {"far": "s"}, 60).collect()
    assert {(r.k, r.t) for r in got} == {(k, t) for k, t, _ in points}
    for r in got:
        near = [(t, v) for k, t, v in points if k == r.k and r.t + low <= t <= r.t + high]
        assert r.n == len(near)
        assert abs(r.s - sum(v for _, v in near)) < 1e-9
        assert abs(r.far - sum(v * (r.t - t) / 60 for t, v in near)) < 1e-6


def test_value_stats(spark, block_rows):
    rng = random.Random(6)
    values = [3.0, 1.0, 1.0, 10.0, None]
    many = [rng.choice([rng.random(), 0.5]) for _ in range(301)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)] + [(None, v) for v in many], "k string, v double")
    counted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))
    got = {r.k: r for r in value_stats(counted, ["k"], "v", "w").collect()}
    assert (got["a"].n, got["a"].mean, got["a"].median) == (4, 3.75, 2.0) and abs(got["a"].std - 4.272002) < 1e-6
    assert (got["b"].n, got["b"].mean, got["b"].median) == (0, None, None)
    assert got[None].n == 301 and got[None].median == sorted(many)[150] and abs(got[None].mean - sum(many) / 301) < 1e-9


def greedy_model(times: list[datetime], window: int, max_shift: int, cap: int) -> list[tuple]:
    """One movement at a time, as the rule is stated; equal priorities go by index."""
    peak = {6, 7, 8, 9, 18, 19, 20, 21}
    floor = lambda t: t - timedelta(minutes=t.minute % window)
    count, members, moves = defaultdict(int), defaultdict(list), []
    for i, t in enumerate(times):
        count[floor(t)] += 1
        members[floor(t)].append(i)
    for slot in sorted(members):
        over = count[slot] - cap
        for i in members[slot][: max(over, 0)]:
            best = None
            for k in range(1, max_shift // window + 1):
                for d in (-k, k):
                    target = slot + timedelta(minutes=d * window)
                    cost = k * window / max_shift + 0.3 * (1.5 if target.hour in peak else 1.0)
                    if count[target] < cap and (best is None or cost < best[0]):
                        best = (cost, target, d * window)
            if best:
                count[best[1]] += 1
                count[slot] -= 1
                moves.append((i, best[2]))
    return sorted(moves)


@pytest.mark.parametrize("seed,window,shift,cap,batch", [(1, 5, 15, 2, 1000), (2, 5, 30, 1, 1), (3, 10, 20, 3, 3), (4, 5, 60, 2, 2)])
def test_tuner_equals_one_by_one_model(spark, monkeypatch, seed, window, shift, cap, batch):
    monkeypatch.setattr(tuner, "_BATCH", batch)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 1 << 20 if seed % 2 else 20)
    rng = random.Random(seed)
    clusters = [rng.randrange(0, 900) for _ in range(12)]
    times = [START + timedelta(minutes=rng.choice(clusters) + int(rng.expovariate(1 / 8))) for _ in range(260)]
    df = frame(spark, [{"flight_id": f"F{i}", "sched_dep": t} for i, t in enumerate(times)]).repartition(7)
    moves = tuner.greedy_slot_tuner(df, window_min=window, max_shift_min=shift, per_window_capacity=cap).collect()
    assert sorted((r.row_id, r.shift_min) for r in moves) == greedy_model(times, window, shift, cap)
    assert len({r.row_id for r in moves}) == len(moves) > 0
    after = [r.slot_start + timedelta(minutes=r.shift_min) for r in moves]
    left = defaultdict(int)
    for t in times:
        left[t - timedelta(minutes=t.minute % window)] += 1
    for r in moves:
        left[r.slot_start] -= 1
        left[r.slot_start + timedelta(minutes=r.shift_min)] += 1
    assert all(left[t] <= cap for t in after) and sum(left.values()) == len(times)


def dense_influence(rows, steps=3, decay=0.85):
    """All pairs in a table, the latest kind overwriting earlier ones."""
    weight = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["sched_dep"] is None, rows[i]["sched_dep"] or START, i))

    def chain(key, n, value):
        groups = defaultdict(list)
        for i in order:
            if key(rows[i]) is not None:
                groups[key(rows[i])].append(i)
        for members in groups.values():
            for a, i in enumerate(members):
                for b in range(a + 1, min(a + n, len(members) - 1) + 1):
                    weight[(i, members[b])] = value(rows[i], rows[members[b]], b - a)

    def turn(x, y, _):
        if y["sched_dep"] is None or x["sched_arr"] is None:
            return 0.3
        gap = (y["sched_dep"] - x["sched_arr"]).total_seconds() / 60
        return 0.9 if gap < 45 else 0.7 if gap < 90 else 0.4

    def slot(r):
        t = r["sched_dep"] or r["sched_arr"]
        return t and t - timedelta(minutes=t.minute % 5)

    chain(lambda r: r["tail_number"], 1, turn)
    chain(slot, 3, lambda x, y, k: 0.3 * 0.8 ** (k - 1))
    chain(lambda r: r["gate"], 1, lambda x, y, k: 0.35)
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            if x["carrier"] and x["carrier"] == y["carrier"] and x["sched_dep"] and y["sched_dep"]:
                h = (y["sched_dep"] - x["sched_dep"]).total_seconds() / 3600
                if 2 <= h <= 6:
                    weight[(i, j)] = 0.4 * max(0, 1 - (h - 2) / 4)
    s, reach, factor = [1.0] * len(rows), [0.0] * len(rows), decay
    for _ in range(steps):
        nxt = [0.0] * len(rows)
        for (i, j), w in weight.items():
            nxt[j] += w * s[i]
        s = nxt
        reach = [r + factor * x for r, x in zip(reach, s)]
        factor *= decay
    return reach


def test_influence_equals_dense_matrix(spark, block_rows):
    rows = random_rows(11, 150, 900)
    df = frame(spark, rows).repartition(4)
    got = {r.row_id: r.reach for r in influence.propagate(df, 3, 0.85).collect()}
    want = dense_influence(rows)
    assert len(got) > 100 and all(abs(got.get(i, 0.0) - want[i]) < 1e-8 for i in range(len(rows)))


def test_results_do_not_depend_on_partitioning(spark):
    df = movements(spark, SF)
    shuffled = df.repartition(13, F.hash("gate")).sortWithinPartitions(F.desc("row_id"))

    def same(metric):
        a, b = (sorted(map(str, metric(x).collect())) for x in (df, shuffled))
        assert a and a == b

    same(lambda x: slots.busiest_slots(x))
    same(lambda x: delays.delay_propagation_analysis(x))
    same(lambda x: influence.dependency_edges(x))
    same(lambda x: tuner.greedy_slot_tuner(x, per_window_capacity=1))


def test_load_index_sums_to_rows(spark):
    df = movements(spark, SF)
    rli = slots.runway_load_index(df)
    total, rows, first, last = rli.agg(F.sum("movements"), F.count("*"), F.min("slot_start"), F.max("slot_start")).first()
    assert total == df.count() and rows == (last - first) // timedelta(minutes=5) + 1

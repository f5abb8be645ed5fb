"""Hand-worked cases of every operator family."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from slotflow.functions import scoring, text, times
from slotflow.functions.quantiles import t_critical
from slotflow.operators import delays, influence, labels, scope, sites, slots, tuner
from slotflow.plans import answers, reports, routing
from slotflow.schema import COLUMNS, MOVEMENT_SCHEMA, conform
from slotflow.sources import columns, ingest, tables


def at(clock: str, day: int = 2) -> datetime:
    h, m, *s = (int(x) for x in clock.split(":"))
    return datetime(2024, 3, day, h, m, *(s or [0]))


def frame(spark, rows: list[dict]):
    """Canonical movements from partial rows; row ids count up."""
    full = [tuple({"row_id": i, **r}.get(c) for c in COLUMNS) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, MOVEMENT_SCHEMA)


def departures(spark, clocks, **extra):
    return frame(spark, [{"flight_id": f"F{i}", "sched_dep": at(c), **extra} for i, c in enumerate(clocks)])


# ---- load index -----------------------------------------------------------------------


def test_load_index(spark):
    df = departures(spark, ["10:00", "10:01", "10:04", "10:12"])
    rows = slots.runway_load_index_enhanced(df, ops_per_window_capacity=2).orderBy("slot_start").collect()
    got = [
        (r.movements, r.rli, r.capacity_utilization_pct, r.bottleneck_risk, r.predicted_delay, r.estimated_queue_length)
        for r in rows
    ]
    assert got == [(3, 2.25, 150.0, "Critical", 62.5, 1.0), (0, 0.0, 0.0, None, 0.0, 0.0), (1, 0.75, 50.0, "Medium", 0.0, 0.0)]


def test_risk_edges(spark):
    loads = spark.createDataFrame([(x,) for x in (0.0, 0.7, 0.9, 1.1, 1.11)], "x double")
    got = [r[0] for r in loads.select(scoring.risk_label(F.col("x"))).collect()]
    assert got == [None, "Low", "Medium", "High", "Critical"]


def test_gap_of_centuries_is_dense(spark):
    df = frame(spark, [{"sched_dep": datetime(1999, 12, 31)}, {"sched_dep": datetime(2031, 1, 1)}])
    dense = slots.dense_slots(df, window_min=5)
    days = (date(2031, 1, 1) - date(1999, 12, 31)).days
    assert dense.count() == days * 288 + 1
    assert dense.agg(F.sum("movements")).first()[0] == 2


def test_window_must_divide_a_day(spark):
    with pytest.raises(ValueError):
        slots.slot_counts(departures(spark, ["10:00"]), window_min=7)


# ---- best time ------------------------------------------------------------------------


def test_best_time(spark):
    plan = [("10:00", 2.0), ("10:05", 4.0), ("10:10", 6.0), ("11:00", 10.0)]
    df = frame(spark, [{"sched_dep": at(c), "dep_delay_min": d} for c, d in plan])
    rows = slots.best_time_to_operate_enhanced(df, kind="departure").collect()
    got = [(r.slot_start.hour * 100 + r.slot_start.minute, r.mean_delay_min, r.ci_lower, r.ci_upper, r.reliability_score, r.n) for r in rows]
    assert got == [
        (1000, 4.0, -0.97, 8.97, 80.0, 3),
        (1100, 10.0, 10.0, 10.0, None, 1),
        (1030, None, None, None, None, 0),
    ]
    assert rows[0].median_delay_min == 4.0


def test_t_values(spark):
    known = {1: 12.7062, 2: 4.3027, 5: 2.5706, 10: 2.2281, 30: 2.0423, 120: 1.9799}
    at = spark.createDataFrame([(d,) for d in known], "d bigint")
    assert {r.d: round(r.t, 4) for r in at.select("d", t_critical(F.col("d"), 0.95).alias("t")).collect()} == known
    dofs = spark.createDataFrame([(200,), (201,), (100000,), (0,)], "d bigint")
    at200, at201, far, none = [r[0] for r in dofs.select(t_critical(F.col("d"), 0.95)).collect()]
    assert 0 < at200 - at201 < 1e-4 and abs(far - 1.959988) < 1e-5 and none is None


def test_clock_slots_and_trend(spark):
    rows = [{"sched_dep": at("08:00", d)} for d in (1, 2, 3, 4) for _ in range(d)]
    clock = slots.busiest_slots_enhanced(frame(spark, rows), slot_key="clock").first()
    assert (clock.movements, clock.days_observed, clock.avg_per_day, clock.trend) == (10, 4, 2.5, "increasing")
    fixed = slots.busiest_slots_enhanced(frame(spark, rows), slot_key="absolute").first()
    assert (fixed.movements, fixed.days_observed, fixed.std_dev, fixed.trend) == (4, 1, None, "insufficient")
    flat = slots.busiest_slots_enhanced(frame(spark, [{"sched_dep": at("08:00", d)} for d in (1, 2, 3)]), slot_key="clock")
    assert flat.first().trend == "stable"


# ---- propagation and influence -----------------------------------------------------------


def test_delay_propagation(spark):
    plan = [("10:00", 20.0), ("11:00", 4.0), ("11:30", 8.0), ("12:30", 0.0)]
    df = frame(spark, [{"flight_id": c, "sched_dep": at(c), "dep_delay_min": d} for c, d in plan])
    got = {
        r.initiating_flight: (r.initial_delay, round(r.avg_delay_propagation, 6), r.affected_flights, r.total_future_flights)
        for r in delays.delay_propagation_analysis(df).collect()
    }
    assert got == {"10:00": (20.0, 2.0, 1, 2), "11:30": (8.0, 0.0, 0, 1)}


def test_propagation_bounds_are_open_and_closed(spark):
    plan = [("10:00", 20.0), ("10:00", 1.0), ("12:00", 2.0), ("12:00:01", 9.0)]
    df = frame(spark, [{"flight_id": str(i), "sched_dep": at(c), "dep_delay_min": d} for i, (c, d) in enumerate(plan)])
    rows = delays.delay_propagation_analysis(df).collect()
    assert [(r.initiating_flight, r.total_future_flights) for r in rows] == [("0", 1)]


def _rotation(spark):
    legs = [("A", "06:00", "07:00"), ("B", "07:30", "15:00"), ("C", "16:00", "17:00")]
    return frame(
        spark,
        [
            {"flight_id": f, "tail_number": "T", "sched_dep": at(d), "sched_arr": at(a), "arr_delay_min": 10.0}
            for f, d, a in legs
        ],
    )


def test_influence_both_directions(spark):
    df = _rotation(spark)
    into = {r.flight_id: r for r in influence.influence_table(df).collect()}
    assert round(into["A"].influence_delta_total_delay, 5) == 10
    assert round(into["B"].cascading_impact, 5) == 7.65 and round(into["B"].influence_ratio, 5) == 0.765
    assert round(into["C"].influence_delta_total_delay, 5) == 20.50175
    out = influence.influence_table_enhanced(df, steps=3, direction="outgoing").collect()
    assert {r.flight_id: round(r.influence_delta_total_delay, 5) for r in out} == {"A": 22.20175, "B": 15.95, "C": 10.0}


def test_runway_and_crew_weights(spark):
    queue = departures(spark, ["10:00", "10:01", "10:02", "10:03", "10:04"])
    edges = influence.dependency_edges(queue).filter("src = 0").orderBy("dst").collect()
    assert [(e.dst, round(e.weight, 6)) for e in edges] == [(1, 0.3), (2, 0.24), (3, 0.192)]
    crew = departures(spark, ["06:00", "08:00", "10:00", "12:00"], carrier="AI")
    later = {r.row_id: (r.links, round(r.weight_sum, 6)) for r in influence.crew_links(crew, incoming=False).collect()}
    assert later == {0: (3, 0.6), 1: (2, 0.6), 2: (1, 0.4), 3: (0, 0.0)}


def test_later_kind_wins_and_crew_takes_the_pair(spark):
    same = {"tail_number": "T", "gate": "G"}
    df = frame(
        spark,
        [
            {"sched_dep": at("06:00"), "sched_arr": at("06:10"), **same},
            {"sched_dep": at("06:20"), "sched_arr": at("06:30"), **same},
            {"sched_dep": at("09:00"), "sched_arr": at("09:30"), "carrier": "AI", **same},
            {"sched_dep": at("12:00"), "carrier": "AI", **same},
        ],
    )
    got = {(e.src, e.dst): (e.kind, e.weight) for e in influence.effective_edges(influence.dependency_edges(df)).collect()}
    assert got == {(0, 1): ("gate", 0.35), (1, 2): ("gate", 0.35)}


# ---- tuner --------------------------------------------------------------------------------


def _moves(df, **kw):
    return sorted((r.shift_min, round(r.move_cost, 6)) for r in tuner.greedy_slot_tuner(df, **kw).collect())


def test_tuner_ties_and_peaks(spark):
    third = 1 / 3
    noon = _moves(departures(spark, ["12:00"] * 5), per_window_capacity=3)
    assert noon == [(-5, round(third + 0.3, 6))] * 2
    ten = _moves(departures(spark, ["10:00"] * 5), per_window_capacity=3)
    assert ten == [(5, round(third + 0.3, 6))] * 2
    mixed = _moves(departures(spark, ["12:00"] * 6 + ["11:55"] * 2 + ["12:05"] * 3), per_window_capacity=3)
    assert mixed == [(-10, round(2 * third + 0.3, 6))] * 2 + [(-5, round(third + 0.3, 6))]
    assert _moves(departures(spark, ["12:00"] * 6), per_window_capacity=3, max_shift_min=4) == []


def test_priority(spark):
    row = {"sched_dep": at("07:10"), "carrier": "AI", "tail_number": "VT"}
    df = frame(spark, [{**row, "dep_delay_min": -20.0}, row, {**row, "dep_delay_min": -20.0, "tail_number": " "}])
    score = scoring.move_priority(F.col("dep_delay_min"), F.col("carrier"), F.col("sched_dep"), F.col("tail_number"))
    assert [round(r[0], 6) for r in df.select(score).collect()] == [72.0, 0.0, 60.0]


def test_multi_objective(spark):
    moves = spark.createDataFrame(
        [(1, at("08:00"), 5, at("08:00"), 1), (2, at("12:00"), -15, at("12:00"), 1)],
        "row_id bigint, old_time timestamp_ntz, shift_min bigint, slot_start timestamp_ntz, slot_rank bigint",
    )
    assert [round(r.composite_score, 6) for r in tuner.score_moves(moves).collect()] == [1.166667, 0.5]
    only = tuner.score_moves(moves, ["minimize_total_shifts"]).collect()
    assert [round(r.composite_score, 6) for r in only] == [0.1, 0.1]
    with pytest.raises(ValueError):
        tuner.score_moves(moves, ["minimise_noise"])


def test_shift_without_new_time(spark):
    df = departures(spark, ["12:00", "12:01"])
    sugg = spark.createDataFrame([(1, 10)], "row_id bigint, shift_min bigint")
    after = tuner.build_tuned_schedule(df, sugg).orderBy("row_id").collect()
    assert [r.scheduled_departure_after for r in after] == ["2024-03-02 12:00", "2024-03-02 12:11"]


# ---- fallbacks, scopes, consolidation --------------------------------------------------------


def test_delay_fallback(spark):
    df = departures(spark, ["10:00"] * 5 + ["10:30"])
    rows = delays.ensure_delay_metric(df, 2).collect()
    assert sorted(r.dep_delay_min for r in rows) == [0.0] + [9.0] * 5 and all(r.used_fallback for r in rows)


def test_consolidation(spark):
    df = departures(spark, ["10:00"] * 4 + ["12:10"] * 2)
    got = {r.metric: r.value for r in slots.consolidation(df).collect()}
    assert got == {"total_departures": 6.0, "max_in_any_hour": 4.0, "share_top_2h_block_%": 66.7, "share_top_3h_block_%": 100.0}
    short = {r.metric: r.value for r in slots.consolidation(departures(spark, ["10:00"])).collect()}
    assert short["share_top_2h_block_%"] is None
    assert slots.consolidation(departures(spark, [])).count() == 0


def test_scopes(spark):
    df = frame(spark, [{"origin": "BOM", "destination": "DEL"}, {"origin": "DEL", "destination": None}, {"airport": "bom intl"}])
    ids = lambda *a, **k: sorted(r.row_id for r in scope.scope_airport(df, *a, **k).collect())
    assert ids("bom") == [0, 2] and ids("bom", "departure") == [0] and ids("DEL", "arrival") == [0]
    assert ids("B.M") == [] and ids("B.M", on_empty="all") == [0, 1, 2] and ids("") == [0, 1, 2]
    assert ids("intl", "origin_first") == [2] and ids("XXX", "origin_first") == [0, 1, 2]


def test_next_window_labels(spark):
    df = departures(spark, ["10:00", "10:01", "15:00"])
    now = reports.peak_next_hours(df, at("09:30"), 2).first()
    assert (now.peak_rli, now.window_label) == (1.5, "09:30–11:30")
    later = reports.peak_next_hours(df, at("12:30"), 2).first()
    assert (later.peak_rli, later.window_label) == (0.75, "15:00–17:00 (next window)")
    past = reports.peak_next_hours(df, at("23:30"), 2).first()
    assert past.window_label == "10:00–12:00 (next window)"


def test_dates(spark):
    df = frame(spark, [{"sched_arr": at("01:00", 5)}, {"sched_arr": None}])
    assert [r.date for r in scope.ensure_date(df, date(2024, 1, 1)).collect()] == [date(2024, 3, 5), None]
    empty = frame(spark, [{"flight_id": "x"}])
    assert scope.ensure_date(empty, date(2024, 1, 1)).first().date == date(2024, 1, 1)
    dated = frame(spark, [{"date": date(2024, 3, d)} for d in (1, 2, 3)])
    assert scope.filter_dates(dated, "2024-03-03", "2024-03-02").count() == 2


# ---- questions ------------------------------------------------------------------------------

QUESTIONS = [
    ("when is it most crowded at BOM", "busiest", None, "BOM", 12),
    ("best hour for a takeoff out of bombay", "best_departure", "departure", "BOM", 12),
    ("which landing window is best, DEL?", "best_arrival", "arrival", "DEL", 12),
    ("congestion if cap = 10", "rli", None, None, 10),
    ("please flatten the morning with capacity=10", "tuner", None, None, 10),
    ("delays that propagate downstream", "cascade", None, None, 12),
    ("does a storm matter", "weather", None, None, 12),
    ("CAP11", "capacity", None, None, 11),
    ("are flights concentrated in NEW  DELHI", "consolidation", None, "DEL", 12),
    ("a busy hour, capacity 8", "busiest", None, None, 8),
    ("good morning", None, None, None, 12),
]


def test_questions(spark):
    df = spark.createDataFrame([(q[0],) for q in QUESTIONS], "text string")
    rows = routing.classify(df).collect()
    assert [(r.text, r.intent, r.kind, r.airport, r.capacity) for r in rows] == QUESTIONS
    helped = df.select(routing.intent(F.lit("what can I ask"), with_help=True)).first()[0]
    assert helped == "help"


def test_answers(spark):
    plan = ["10:00", "10:01", "10:04", "10:12", "12:30"]
    base = departures(spark, plan, origin="DEL", destination="BOM", dep_delay_min=6.0, arr_delay_min=3.0, sched_arr=at("14:00"))
    df = spark.createDataFrame([(q[0],) for q in QUESTIONS] * 2 + [("cap=1",), ("tune it, cap=2",), ("best time to land in BLR",)], "text string")
    found = {}
    for r in answers.answers(df, base).orderBy("metric", "airport", "capacity", "place").collect():
        found.setdefault((r.metric, r.airport, r.capacity), []).append(r)
    assert len(found) == 12 and not any(k[0] == "weather" for k in found)
    assert found["busiest", "BOM", None][0].answer.movements == 4 and found["busiest", "BOM", None][0].questions == 2
    assert len(found["rli", None, 10]) == 31 and found["rli", None, 10][0].answer.rli == 0.45
    assert [(r.answer.peak_rli, r.answer.overloaded_windows) for r in found["capacity", None, 1]] == [(4.5, 3)]
    assert [(r.place, r.answer.shift_min) for r in found["tuner", None, 2]] == [(1, 5)]
    assert [r.answer for r in found["tuner", None, 10]] == [None]
    assert [r.answer.metric for r in found["consolidation", "DEL", None]] == slots.CONSOLIDATION_METRICS
    # arrivals of DEL: no movement has it as its destination
    assert [r.place for r in found["best_arrival", "DEL", None]] == [None]
    assert len(found["cascade", None, 12]) == 5


def test_jobs_do_not_grow_with_the_requests(spark):
    base = departures(spark, ["10:00", "10:01", "10:04"], origin="DEL")

    def jobs(texts):
        group = f"answers {len(texts)}"
        spark.sparkContext.setJobGroup(group, group)
        df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
        rows = answers.answers(df, base).filter("metric = 'capacity'").collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), len(rows)

    few, many = jobs(["capacity 1", "capacity 2"]), jobs([f"capacity {i} at DEL" for i in range(1, 40)])
    assert (few[1], many[1]) == (2, 39) and many[0] <= few[0]


def test_answers_of_odd_tables(spark):
    texts = spark.createDataFrame([("busiest at DEL",), ("best departure from DEL",), ("tune DEL cap=1",), ("cascade DEL cap=1",), ("cascade DEL cap=2",), (None,)], "text string")
    plan = ["10:00"] * 4
    # nothing names the airport: the whole table is its view, but not its origin or its paths
    other = departures(spark, plan, origin="MAA", destination="BLR", dep_delay_min=6.0)
    got = {(r.metric, r.capacity): r for r in answers.answers(texts, other).collect() if r.place in (None, 1)}
    assert got["busiest", None].answer.movements == 4 and got["best_departure", None].answer is None
    assert got["tuner", 1].answer.shift_min == 5 and got["cascade", 1].answer is None
    # only the airport column is filled, and no delay is known: three minutes for each movement over capacity
    bare = departures(spark, plan, airport="DEL intl")
    got = {(r.metric, r.capacity, r.place): r.answer for r in answers.answers(texts, bare).collect()}
    assert got["best_departure", None, 1].n == 4
    assert sorted(v.direct_impact for k, v in got.items() if k[:2] == ("cascade", 1)) == [9.0] * 4
    assert sorted(v.direct_impact for k, v in got.items() if k[:2] == ("cascade", 2)) == [6.0] * 4
    for empty in (answers.answers(texts, other.limit(0)), answers.answers(texts.limit(0), other)):
        assert all(r.place is None or r.metric == "capacity" for r in empty.collect())


# ---- ingestion ------------------------------------------------------------------------------


def test_headers(spark):
    rows = [(["Flight No", "STD", "STA"],), (["Flight No", "10:00"],), ([" flight_no ", None, "GATE"],), ([],)]
    df = spark.createDataFrame(rows, "cells array<string>")
    assert [r[0] for r in df.select(columns.looks_like_header(F.col("cells"))).collect()] == [True, False, True, False]
    found = columns.detect_columns(["From", "Origin", "Sch_Departure", "STD", "x"])
    assert found == {"origin": "From", "sched_dep": "Sch_Departure"}


def test_time_texts(spark):
    cases = {
        "9:05": at("09:05"),
        "09:05:07": at("09:05:07"),
        "9:05 PM": at("21:05"),
        "9:05:07 pm": at("21:05:07"),
        "10:00PM": at("22:00"),
        "12:15 am": at("00:15"),
        "13:05 PM": None,
        "25:00": None,
        "23:50": at("23:50"),
        "05/03/2024 01:00": at("01:00", 5),
        "2024-03-02": at("00:00"),
        "2024-03-05T07:08:09": at("07:08:09", 5),
        "2024/3/5 7:08": at("07:08", 5),
        "5-Mar-2024 7:08": at("07:08", 5),
        "5/3/24 7:08 PM": at("19:08", 5),
        "31/02/2024 10:00": None,
        "soon": None,
        "nan": None,
    }
    rows = spark.createDataFrame([(k, date(2024, 3, 2)) for k in cases], "t string, d date").withColumn("k", F.col("t"))
    got = {r.k: r.t for r in times.resolve_times(rows, ["t"], "d").collect()}
    assert got == cases


def test_flight_ids_and_delays(spark):
    pairs = [("AI", "101.0", "AI101"), ("ai", "AI101", "AI101"), ("9W", "9W5", "9W5"), (None, "77", "77"), (None, None, "4"), ("AI", " 1 2 ", "AI12")]
    df = spark.createDataFrame([(i, c, n) for i, (c, n, _) in enumerate(pairs)], "row_id bigint, c string, n string")
    got = [r[0] for r in df.select(text.flight_id(F.col("c"), F.col("n"), F.col("row_id"))).collect()]
    assert got == [want for *_, want in pairs]
    raw = spark.createDataFrame(
        [(0, "02/03/2024", "10:00", "10:12:30"), (1, None, "11:00", None)], "row_id bigint, Date string, STD string, ATD string"
    )
    out = ingest.to_movements(raw).orderBy("row_id").collect()
    assert [r.dep_delay_min for r in out] == [12.5, None] and out[1].sched_dep == at("11:00")


def test_blocks(spark):
    sheet = [
        ["Title", None, None],
        ["Flight No", "STD", "From", "Gate"],
        ["101", "10:00", "BOM", None],
        [None, " ", None, None],
        ["102", "10:05", "DEL", None],
        ["From", "Flight No", "STD"],
        ["HYD", "103", "11:00"],
        ["Flight No", "STD", "STA"],
        ["lost", "11:30", None],
    ]
    plain = [["Src", "Fl.No", "Sched Dep"], ["MAA", "104", "12:00"]]
    rows = [("f", name, i, c) for name, body in (("s1", sheet), ("s2", plain)) for i, c in enumerate(body)]
    cells = spark.createDataFrame(rows, "source_file string, sheet string, row_idx bigint, cells array<string>")
    got = [(r.sheet, r.flight_number, r.origin, r.sched_dep, r.gate) for r in tables.read_blocks(cells).orderBy("row_id").collect()]
    assert got == [
        ("s1", "101", "BOM", "10:00", None),
        ("s1", "102", "DEL", "10:05", None),
        ("s1", "103", "HYD", "11:00", None),
        ("s2", "104", "MAA", "12:00", None),
    ]


def test_ingest_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        ingest.ingest(spark, str(tmp_path / "x.xlsx"))
    (tmp_path / "e.csv").write_text("From,To\n")
    with pytest.raises(ValueError, match="no rows"):
        ingest.ingest(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ValueError, match="row_id"):
        conform(spark.range(1).toDF("x"))


def test_write_and_read_back(spark, tmp_path):
    df = frame(spark, [{"flight_id": "A", "date": date(2024, 3, d), "sched_dep": at("10:00", d)} for d in (1, 2)])
    (tmp_path / "in").mkdir()
    df.write.mode("overwrite").parquet(str(tmp_path / "in" / "m.parquet"))
    out = ingest.run_ingest(spark, str(tmp_path / "in" / "m.parquet"), str(tmp_path / "out"))
    back = tables.read_movements(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    pruned = scope.filter_dates(back, "2024-03-02", "2024-03-02")
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().toString()


# ---- labels ---------------------------------------------------------------------------------


def test_labels(spark):
    df = frame(
        spark,
        [
            {"flight_id": "AI101", "carrier": "ai", "flight_number": "101.0", "origin": "bom", "destination": "del", "sched_dep": at("09:05"), "tail_number": "vt-1"},
            {"flight_id": "x", "carrier": "None", "flight_number": "NA", "destination": "DEL"},
            {"flight_id": "AI101", "carrier": "AI", "flight_number": "AI7"},
        ],
    )
    got = [r.label for r in labels.movement_labels(df).orderBy("row_id").collect()]
    assert got == ["AI101 BOM→DEL · 02-Mar 09:05 · VT-1", "101 DEL", "AI7"]
    table = spark.createDataFrame([("AI101", 1), ("zz", 2)], "flight_id string, v int")
    shown = {r.v: r.flight_id for r in labels.show_labels(table, df).collect()}
    assert shown == {1: "AI101 BOM→DEL · 02-Mar 09:05 · VT-1", 2: "zz"}


def test_airport_options(spark):
    df = frame(spark, [{"origin": "BOM", "destination": "DEL"}, {"origin": "BOM", "destination": "Mumbai city"}])
    assert [r.airport for r in sites.airport_options(df).orderBy("rank").collect()] == ["BOM", "DEL", "City", "Mumbai"]
    assert [r.airport for r in sites.airport_options(frame(spark, [{"flight_id": "x"}])).orderBy("rank").collect()] == ["BOM", "DEL"]


# ---- reports --------------------------------------------------------------------------------


def test_reports_of_a_small_peak(spark):
    df = departures(spark, ["12:00"] * 5, origin="BOM", dep_delay_min=10.0, carrier="AI")
    kpi = reports.tuner_kpis(df, reports.Scenario("A", 3, 1.0, 15)).first()
    assert (kpi.peak_before, kpi.peak_after, kpi.moved, kpi.minutes_shifted) == (2.5, 1.5, 2, 10)
    assert (kpi.delay_delta, kpi.avg_saved_per_flight, kpi.efficiency, kpi.demo_mode) == (20.0, 10.0, 2.0, False)
    calm = reports.tuner_kpis(df, reports.Scenario("A", 9, 1.0, 15)).first()
    assert calm.demo_mode and calm.moved == 1
    insight = reports.summarize_insights(df, reports.Scenario("A", 3)).first()
    assert (insight.records, insight.over_windows, insight.moved) == (5, 1, 2)
    assert insight.best_departure == at("12:00") and insight.best_arrival is None
    brief = reports.ops_brief(df, "BOM", reports.Scenario("A", 3)).first()
    assert (brief.airport, brief.flights_moved, brief.est_delay_saved_min) == ("BOM", 2, 20.0)
    tips = [r.rule_id for r in reports.recommendations(df, 3).collect()]
    assert tips == [1, 2, 3]
    table = reports.compare_scenarios(df, [reports.Scenario("big", 9), reports.Scenario("small", 3)]).collect()
    assert [(r.scenario, r.moved) for r in table] == [("small", 2), ("big", 0)]


def test_exports(spark, tmp_path):
    df = departures(spark, ["12:00"] * 5, origin="BOM", carrier="AI", flight_number="7", dep_delay_min=10.0)
    moves = tuner.greedy_slot_tuner(df, per_window_capacity=3)
    path = reports.export_tuned_schedule(df, moves, str(tmp_path / "tuned"))
    rows = spark.read.option("header", True).csv(path).collect()
    assert sorted(r.scheduled_departure_after[-5:] for r in rows) == ["11:55"] * 2 + ["12:00"] * 3
    assert {r.flight_id for r in rows} == {"AI7 BOM · 02-Mar 12:00"}
    brief = reports.export_ops_brief(df, str(tmp_path / "brief"), "BOM", reports.Scenario("A", 3))
    assert spark.read.option("header", True).csv(brief).first().flights_moved == "2"


def test_reports_of_nothing(spark):
    df = departures(spark, [])
    assert [r.rule_id for r in reports.recommendations(df).collect()] == [0]
    assert reports.tuner_kpis(df, reports.Scenario("A")).count() == 0
    assert tuner.greedy_slot_tuner(df).columns == tuner.greedy_slot_tuner(departures(spark, ["10:00"])).columns

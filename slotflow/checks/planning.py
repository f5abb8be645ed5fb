"""Checks of tuning, indicators, scenarios and question routing.

The tuner's SQL twin replays the greedy rule move by move with a recursive query on
the one-day view (every movement re-anchored to 2024-02-01).
"""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotflow.checks.adapter import MOVEMENTS_SQL, SPARSE_SQL, movements, movements_sparse, present, table, with_sql
from slotflow.checks.flow import influence_cte
from slotflow.checks.records import label_sql
from slotflow.checks.slots import BY, CAP, bucket, rounded
from slotflow.functions.scoring import move_priority, relief_score, rotation_weight
from slotflow.operators import tuner
from slotflow.operators.scope import ops_view
from slotflow.operators.slots import slot_counts
from slotflow.plans import reports, routing
from slotflow.plans.reports import Scenario
from slotflow.session import shared_folder

DAY = date(2024, 2, 1)
NOW = datetime(2024, 1, 15, 9, 30, 20)
DAY_CAP = 8
SCENARIOS = [
    Scenario("A", 8, 1.0, 15),
    Scenario("B", 8, 0.8, 15),
    Scenario("C", 6, 1.0, 30),
    Scenario("D", 12, 1.2, 15),
]
ONE = [Scenario("A", DAY_CAP, 1.0, 15)]


def movements_day(spark: SparkSession, sf: str) -> DataFrame:
    return ops_view(movements(spark, sf), DAY)


def _day_sql(views=MOVEMENTS_SQL, source="movements"):
    return f"""{views},
day AS (SELECT * REPLACE (TIMESTAMP '2024-02-01' + (sched_dep - date_trunc('day', sched_dep)) AS sched_dep) FROM {source})"""


DAY_SQL = _day_sql()


def _replay(scenarios, cap_sql=None, by=True, cases=None):
    """CTEs replaying the tuner on ``day``: moves(scenario, origin, i, j, target, shift, cost, m) and final counts.

    Slots are numbered from ``lo`` slots before midnight, so early targets have a place.
    ``cases`` is a query that gives the scenarios in place of the listed ones.
    """
    lo = max(s.max_shift_min for s in scenarios) // 5
    size = 288 + 2 * lo
    cases = cases or "VALUES " + ", ".join(f"('{s.name}', {s.capacity}, {s.weather}::DOUBLE, {s.max_shift_min})" for s in scenarios)
    group = "origin" if by else "'all'"
    return f""",
scen(scenario, capacity, weather, max_shift) AS ({cases}),
n AS (SELECT {group} AS origin, date_diff('minute', TIMESTAMP '2024-02-01', {bucket('sched_dep', 5)}) // 5 + {lo + 1} AS i, count(*) AS n,
             avg(dep_delay_min) AS mean_delay FROM day GROUP BY ALL),
peaks AS (SELECT origin, max(n) AS peak FROM n GROUP BY origin),
axis AS (SELECT scenario, capacity, weather, max_shift, {cap_sql or 'capacity'} AS cap, origin, unnest(range(1, {size + 1})) AS i
         FROM scen, peaks),
start AS (SELECT scenario, any_value(capacity) AS capacity, any_value(max_shift) AS max_shift, any_value(cap) AS cap, a.origin,
                 list(coalesce(n, 0) ORDER BY a.i) AS counts FROM axis a LEFT JOIN n ON n.origin = a.origin AND n.i = a.i
          GROUP BY scenario, a.origin),
offers AS (
  SELECT scenario, i, i + d AS target, d * 5 AS shift, abs(d) * 5 / max_shift::DOUBLE
           + 0.3::DOUBLE * (CASE WHEN hour(t) BETWEEN 6 AND 9 OR hour(t) BETWEEN 18 AND 21 THEN 1.5::DOUBLE ELSE 1 END) AS cost, d
  FROM (SELECT scenario, max_shift, i, d, TIMESTAMP '2024-02-01' + to_minutes(CAST((i + d - {lo + 1}) * 5 AS INTEGER)) AS t
        FROM scen, (SELECT unnest(range({lo + 1}, {289 + lo})) AS i), (SELECT unnest(range({-lo}, {lo + 1})) AS d)
        WHERE d <> 0 AND abs(d) * 5 <= max_shift)),
steps AS (SELECT *, row_number() OVER (PARTITION BY scenario, i ORDER BY cost, abs(d), d) AS j FROM offers),
ordered AS (SELECT *, (i - {lo + 1}) * {2 * lo} + j AS k FROM steps),
run AS (
  SELECT scenario, origin, cap, counts, 0::BIGINT AS k, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS target, 0::BIGINT AS shift,
         0::DOUBLE AS cost, 0::BIGINT AS m FROM start
  UNION ALL
  SELECT scenario, origin, cap,
         CASE WHEN m = 0 THEN counts ELSE list_transform(counts, lambda x, p: x - CASE WHEN p = ni THEN m WHEN p = nt THEN -m ELSE 0 END) END,
         k, ni, nj, nt, ns, nc, m
  FROM (SELECT r.scenario, r.origin, r.cap, r.counts, r.k + 1 AS k, coalesce(o.i, 0) AS ni, coalesce(o.j, 0) AS nj,
               coalesce(o.target, 0) AS nt, coalesce(o.shift, 0) AS ns, coalesce(o.cost, 0) AS nc,
               coalesce(greatest(0, least(r.counts[o.i] - r.cap, r.cap - r.counts[o.target])), 0) AS m
        FROM run r LEFT JOIN ordered o ON o.scenario = r.scenario AND o.k = r.k + 1
        WHERE r.k < 288 * {2 * lo})),
moves AS (SELECT scenario, origin, i, target, shift, cost, m,
                 coalesce(sum(m) OVER (PARTITION BY scenario, origin, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM run WHERE m > 0),
final AS (SELECT scenario, origin, unnest(counts) AS n, generate_subscripts(counts, 1) AS i FROM run WHERE k = 288 * {2 * lo}),
prio AS (
  SELECT {group} AS origin, row_id, flight_id, sched_dep, date_diff('minute', TIMESTAMP '2024-02-01', {bucket('sched_dep', 5)}) // 5 + {lo + 1} AS i,
         abs(coalesce(dep_delay_min, 0)) * CASE WHEN carrier IN ('AI', '9W', '6E') THEN 2.0::DOUBLE ELSE 1 END
           * CASE WHEN hour(sched_dep) BETWEEN 6 AND 9 OR hour(sched_dep) BETWEEN 18 AND 21 THEN 1.5::DOUBLE ELSE 1 END
           * CASE WHEN tail_number IS NULL THEN 1 ELSE 1.2::DOUBLE END AS score
  FROM day),
ranked AS (SELECT *, row_number() OVER (PARTITION BY origin, i ORDER BY score, row_id) AS rn FROM prio),
sugg AS (
  SELECT scenario, r.origin, row_id, flight_id, sched_dep AS old_time, sched_dep + to_minutes(CAST(shift AS INTEGER)) AS new_time,
         shift AS shift_min, score AS priority_score, cost AS move_cost, {bucket('sched_dep', 5)} AS slot_start, rn AS slot_rank
  FROM ranked r JOIN moves m ON m.origin = r.origin AND m.i = r.i AND rn > before AND rn <= before + m.m)"""


def _recursive(body, views=DAY_SQL):
    return "WITH RECURSIVE" + with_sql(body, views).removeprefix("WITH")


SUGGESTION_COLS = "origin, row_id, flight_id, old_time, new_time, shift_min, {p} AS priority_score, {c} AS move_cost, slot_start, slot_rank"


def tuner_day(spark, sf):
    out = tuner.greedy_slot_tuner(movements_day(spark, sf), per_window_capacity=DAY_CAP, by=BY)
    return rounded(out, "priority_score", "move_cost")


TUNER_SQL = _recursive(
    _replay(ONE)
    + "\nSELECT "
    + SUGGESTION_COLS.format(p=present("priority_score", 4), c=present("move_cost", 4))
    + " FROM sugg"
)


def tuner_of_airport(spark, sf):
    out = tuner.greedy_slot_tuner(movements_day(spark, sf), airport="bom", per_window_capacity=DAY_CAP)
    return rounded(out, "priority_score", "move_cost")


TUNER_AT_SQL = _recursive(
    _replay(ONE, by=False)
    + "\nSELECT "
    + SUGGESTION_COLS.removeprefix("origin, ").format(p=present("priority_score", 4), c=present("move_cost", 4))
    + " FROM sugg",
    _day_sql(source="movements WHERE origin = 'BOM'"),
)


def tuner_timeline(spark, sf):
    return rounded(tuner.greedy_slot_tuner(movements(spark, sf), per_window_capacity=CAP + 1), "priority_score", "move_cost")


# Overloaded slots more than two reaches (six slots) apart share no target: each run of nearer ones is replayed by itself.
TIMELINE_SQL = _recursive(
    f""",
slots AS (SELECT epoch({bucket('sched_dep', 5)})::BIGINT // 300 AS pos, count(*) AS n FROM movements GROUP BY 1),
over AS (
  SELECT pos, sum(CASE WHEN pos - prev <= 6 THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS island
  FROM (SELECT pos, lag(pos) OVER (ORDER BY pos) AS prev FROM slots WHERE n > {CAP + 1})),
spans AS (SELECT island, min(pos) - 3 AS lo, max(pos) + 4 AS hi FROM over GROUP BY island),
start AS (
  SELECT island, list(coalesce(n, 0) ORDER BY p.pos) AS counts
  FROM (SELECT island, unnest(range(lo, hi)) AS pos FROM spans) p LEFT JOIN slots ON slots.pos = p.pos GROUP BY island),
offers AS (
  SELECT o.island, o.pos, d, o.pos - lo + 1 AS i, o.pos + d - lo + 1 AS t, dense_rank() OVER (PARTITION BY o.island ORDER BY o.pos) AS turn,
         abs(d) * 5 / 15::DOUBLE + 0.3::DOUBLE * CASE WHEN (o.pos + d) % 288 // 12 BETWEEN 6 AND 9 OR (o.pos + d) % 288 // 12 BETWEEN 18 AND 21 THEN 1.5::DOUBLE ELSE 1 END AS cost
  FROM over o JOIN spans USING (island), (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS d)),
steps AS (SELECT *, (turn - 1) * 6 + row_number() OVER (PARTITION BY pos ORDER BY cost, abs(d), d) AS k FROM offers),
run AS (
  SELECT island, counts, 0::BIGINT AS k, 0::BIGINT AS pos, 0::INTEGER AS d, 0::DOUBLE AS cost, 0::BIGINT AS m FROM start
  UNION ALL
  SELECT island, list_transform(counts, lambda x, p: x - CASE WHEN p = i THEN m WHEN p = t THEN -m ELSE 0 END), k, pos, d, cost, m
  FROM (SELECT r.island, r.counts, s.k, s.pos, s.d, s.cost, s.i, s.t, greatest(0, least(r.counts[s.i] - {CAP + 1}, {CAP + 1} - r.counts[s.t])) AS m
        FROM run r JOIN steps s ON s.island = r.island AND s.k = r.k + 1)),
moves AS (
  SELECT *, coalesce(sum(m) OVER (PARTITION BY pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM run WHERE m > 0),
prio AS (
  SELECT *, epoch({bucket('sched_dep', 5)})::BIGINT // 300 AS pos,
         abs(coalesce(dep_delay_min, 0)) * CASE WHEN carrier IN ('AI', '9W', '6E') THEN 2.0::DOUBLE ELSE 1 END
           * CASE WHEN hour(sched_dep) BETWEEN 6 AND 9 OR hour(sched_dep) BETWEEN 18 AND 21 THEN 1.5::DOUBLE ELSE 1 END
           * CASE WHEN tail_number IS NULL THEN 1 ELSE 1.2::DOUBLE END AS score
  FROM movements),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score, row_id) AS rn FROM prio)
SELECT row_id, flight_id, sched_dep AS old_time, sched_dep + to_minutes(d * 5) AS new_time, CAST(d * 5 AS BIGINT) AS shift_min,
       {present('score', 4)} AS priority_score, {present('cost', 4)} AS move_cost, {bucket('sched_dep', 5)} AS slot_start, rn AS slot_rank
FROM ranked r JOIN moves v ON v.pos = r.pos AND rn > before AND rn <= before + v.m""",
    MOVEMENTS_SQL,
)


def multi_objective(spark, sf):
    out = tuner.multi_objective_tuner(movements_day(spark, sf), per_window_capacity=DAY_CAP, by=BY)
    kept = out.select("origin", "row_id", "congestion_score", "disruption_score", "efficiency_score", "composite_score")
    return rounded(kept, "disruption_score", "efficiency_score", "composite_score")


MULTI_SQL = _recursive(
    _replay(ONE)
    + f""",
scored AS (SELECT *, CASE WHEN hour(old_time) IN (7, 8, 19, 20) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS congestion_score,
                  1 - abs(shift_min) / (max(abs(shift_min)) OVER (PARTITION BY origin))::DOUBLE AS disruption_score,
                  1.0::DOUBLE / count(*) OVER (PARTITION BY origin) AS efficiency_score FROM sugg),
total AS (SELECT *, 0.4 * congestion_score + 0.4 * disruption_score + 0.2 * efficiency_score AS composite_score FROM scored),
best AS (SELECT * FROM total QUALIFY row_number() OVER (PARTITION BY origin ORDER BY round(composite_score, 9) DESC, slot_start, slot_rank) <= 50)
SELECT origin, row_id, congestion_score, {present('disruption_score', 4)} AS disruption_score,
       {present('efficiency_score', 4)} AS efficiency_score, {present('composite_score', 4)} AS composite_score FROM best"""
)


def tuned_times(spark, sf):
    day = movements_day(spark, sf)
    moves = tuner.greedy_slot_tuner(day, per_window_capacity=DAY_CAP, by=BY)
    return tuner.apply_suggestions(day, moves).select("row_id", "sched_dep_after")


def tuned_schedule(spark, sf):
    day = movements_day(spark, sf)
    moves = tuner.greedy_slot_tuner(day, per_window_capacity=DAY_CAP, by=BY)
    out = tuner.build_tuned_schedule(day, moves)
    return out.select("row_id", "flight_id", "carrier", "origin", "scheduled_departure_before", "scheduled_departure_after")


def tuned_schedule_csv(spark, sf):
    """The exported schedule, read back."""
    day = movements_day(spark, sf)
    moves = tuner.greedy_slot_tuner(day, per_window_capacity=DAY_CAP, by=BY)
    path = reports.export_tuned_schedule(day, moves, f"{shared_folder(spark)}/tuned-{uuid.uuid4().hex}")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("flight_id", "carrier", "origin", "scheduled_departure_before", "scheduled_departure_after")


def tuned_by_flight_id(spark, sf):
    """Suggestions keyed by flight id: all rows of an id take the last new time."""
    day = movements_day(spark, sf)
    moves = tuner.greedy_slot_tuner(day, per_window_capacity=DAY_CAP, by=BY)
    return tuner.apply_suggestions(day, moves, key="flight_id").select("row_id", "sched_dep_after")


def tuned_slot_load(spark, sf):
    """Movements per airport counted after tuning: nothing is lost or added."""
    slots = slot_counts(movements_day(spark, sf), "sched_dep", 5, BY).withColumns(
        {"cap": F.lit(DAY_CAP).cast("bigint"), "max_shift": F.lit(15).cast("bigint")}
    )
    after = tuner.slots_after(slots, tuner.plan_moves(slots, 5, BY), BY)
    return after.groupBy("origin").agg(F.sum("movements").alias("movements"))


def move_priorities(spark, sf):
    df = movements(spark, sf)
    score = move_priority(F.col("dep_delay_min"), F.col("carrier"), F.col("sched_dep"), F.col("tail_number"))
    return rounded(df.select("row_id", score.alias("priority"), relief_score(F.col("sched_dep")).alias("relief")), "priority")


def rotation_weights(spark, sf):
    df = movements(spark, sf)
    return df.select("row_id", rotation_weight(F.col("act_arr"), F.col("sched_dep")).alias("weight"))


def demo_capacity(spark, sf):
    slots = slot_counts(movements_day(spark, sf), "sched_dep", 5, BY)
    out = tuner.demo_capacity(slots, 14, BY)
    return out.groupBy("origin").agg(F.max("observed_peak").alias("observed_peak"), F.max("cap").alias("cap"), F.bool_or("demo_mode").alias("demo_mode"))


def capacity_answer(spark, sf):
    return rounded(reports.capacity_answer(movements(spark, sf), CAP, 0.9, by=BY), "peak_rli")


def peak_next_hours(spark, sf):
    return rounded(reports.peak_next_hours(movements(spark, sf), NOW, CAP, by=BY), "peak_rli")


def scenario_load(spark, sf):
    out = reports.tuning_report(movements_day(spark, sf), SCENARIOS, by=BY)
    cols = ["scenario", "origin", "capacity", "weather", "max_shift", "records", "observed_peak", "peak_before", "over_windows", "delay_before"]
    return rounded(out.select(*cols), "peak_before", "delay_before")


SCENARIO_VALUES = ", ".join(f"('{s.name}', {s.capacity}::BIGINT, {s.weather}::DOUBLE, {s.max_shift_min}::BIGINT)" for s in SCENARIOS)
SCENARIO_LOAD_SQL = with_sql(
    f""",
scen(scenario, capacity, weather, max_shift) AS (VALUES {SCENARIO_VALUES}),
n AS (SELECT origin, {bucket('sched_dep', 5)} AS slot, count(*) AS n, coalesce(avg(dep_delay_min), 0) AS d FROM day GROUP BY ALL)
SELECT scenario, origin, capacity, weather, max_shift, CAST(sum(n) AS BIGINT) AS records, max(n) AS observed_peak,
       {present('max(n) * 1.5 / (capacity * weather)', 4)} AS peak_before,
       count(*) FILTER (n * 1.5 / (capacity * weather) > 1) AS over_windows, {present('sum(n * d)', 4)} AS delay_before
FROM n, scen GROUP BY scenario, origin, capacity, weather, max_shift""",
    DAY_SQL,
)

_REPORT_CTE = """,
delays AS (SELECT origin, i, {mean} AS d FROM n),
totals AS (
  SELECT f.scenario, f.origin, max(f.n) AS peak_n, sum(f.n * coalesce(d, 0)) AS delay_after
  FROM final f LEFT JOIN delays d ON d.origin = f.origin AND d.i = f.i GROUP BY ALL),
firsts AS (SELECT n.origin, max(n) AS peak, sum(n) AS records, sum(n * d) AS delay_before FROM n JOIN delays USING (origin, i) GROUP BY n.origin),
moved AS (SELECT scenario, origin, count(DISTINCT flight_id) AS moved, CAST(sum(abs(shift_min)) AS BIGINT) AS minutes FROM sugg GROUP BY ALL),
report AS (
  SELECT s.*, t.origin, peak * 1.5 / (capacity * weather) AS peak_before, peak_n * 1.5 / (capacity * weather) AS peak_after,
         coalesce(moved, 0) AS moved, coalesce(minutes, 0) AS minutes, delay_before - delay_after AS saved, peak, records
  FROM totals t JOIN scen s USING (scenario) JOIN firsts f ON f.origin = t.origin
  LEFT JOIN moved m ON m.scenario = t.scenario AND m.origin = t.origin)"""
REPORT_CTE = _REPORT_CTE.format(mean="coalesce(mean_delay, 0)")


def compare_scenarios(spark, sf):
    out = reports.compare_scenarios(movements_day(spark, sf), SCENARIOS, by=BY)
    return rounded(out, "peak_before", "peak_after", "peak_drop", "saved_min")


COMPARE_SQL = _recursive(
    _replay(SCENARIOS)
    + REPORT_CTE
    + f"""
SELECT scenario, origin, capacity::BIGINT AS capacity, weather, max_shift::BIGINT AS max_shift, {present('peak_before', 4)} AS peak_before,
       {present('peak_after', 4)} AS peak_after, {present('greatest(peak_before - peak_after, 0)', 4)} AS peak_drop, moved,
       {present('saved', 4)} AS saved_min FROM report"""
)

KPI_SCENARIO = Scenario("A", 14, 0.9, 15)
DEMO_CAP = "CASE WHEN capacity >= peak THEN greatest(1, peak - 1) ELSE capacity END"


def tuner_kpis(spark, sf):
    out = reports.tuner_kpis(movements_day(spark, sf), KPI_SCENARIO, by=BY)
    return rounded(out, "peak_before", "peak_after", "peak_drop", "delay_delta", "avg_saved_per_flight", "efficiency")


def _kpi_select(fallback):
    return f"""
SELECT origin, {present('peak_before', 4)} AS peak_before, {present('peak_after', 4)} AS peak_after,
       {present('greatest(peak_before - peak_after, 0)', 4)} AS peak_drop, moved, {present('saved', 4)} AS delay_delta,
       {present('CASE WHEN moved > 0 THEN saved / moved ELSE 0 END', 4)} AS avg_saved_per_flight, minutes AS minutes_shifted,
       {present('CASE WHEN minutes > 0 THEN saved / minutes ELSE 0 END', 4)} AS efficiency, capacity >= peak AS demo_mode,
       {fallback} AS used_fallback FROM report"""


KPIS_SQL = _recursive(_replay([KPI_SCENARIO], DEMO_CAP) + REPORT_CTE + _kpi_select("FALSE"))


def tuner_kpis_sparse(spark, sf):
    day = ops_view(movements_sparse(spark, sf), DAY)
    out = reports.tuner_kpis(day, Scenario("A", DAY_CAP, 1.0, 15), by=BY)
    return rounded(out, "peak_before", "peak_after", "peak_drop", "delay_delta", "avg_saved_per_flight", "efficiency")


KPIS_SPARSE_SQL = _recursive(
    _replay(ONE, DEMO_CAP) + _REPORT_CTE.format(mean=f"(3 * greatest(0, n - {DAY_CAP}))::DOUBLE") + _kpi_select("TRUE"),
    _day_sql(SPARSE_SQL, "movements_sparse"),
)


def ops_brief(spark, sf):
    out = reports.ops_brief(movements_day(spark, sf), None, KPI_SCENARIO, by=BY)
    return rounded(out, "peak_rli_before", "peak_rli_after", "peak_drop", "est_delay_saved_min")


BRIEF_SQL = _recursive(
    _replay([KPI_SCENARIO], DEMO_CAP)
    + REPORT_CTE
    + f"""
SELECT origin AS airport, capacity::BIGINT AS capacity, weather AS weather_factor, {present('peak_before', 4)} AS peak_rli_before,
       {present('peak_after', 4)} AS peak_rli_after, {present('greatest(peak_before - peak_after, 0)', 4)} AS peak_drop,
       moved AS flights_moved, {present('saved', 4)} AS est_delay_saved_min FROM report"""
)


def ops_brief_csv(spark, sf):
    """The exported brief, read back."""
    path = f"{shared_folder(spark)}/brief-{uuid.uuid4().hex}"
    reports.export_ops_brief(movements_day(spark, sf), path, None, KPI_SCENARIO, by=BY)
    kinds = ops_brief(spark, sf).schema
    back = spark.read.option("header", True).schema(kinds).csv(path)
    return rounded(back, "peak_rli_before", "peak_rli_after", "peak_drop", "est_delay_saved_min")


def insights(spark, sf):
    out = reports.summarize_insights(movements_day(spark, sf), Scenario("A", DAY_CAP, 1.0, 15), by=BY)
    return rounded(out, "peak_rli", "saved")


INSIGHTS_SQL = _recursive(
    _replay(ONE, DEMO_CAP)
    + REPORT_CTE
    + f""",
dep AS (SELECT origin, {bucket('sched_dep', 30)} AS slot, {present('avg(dep_delay_min)', 2)} AS d FROM day GROUP BY ALL),
arr AS (SELECT origin, {bucket('sched_arr', 30)} AS slot, {present('avg(arr_delay_min)', 2)} AS d FROM day GROUP BY ALL),
best_dep AS (SELECT origin, min(d) AS best_departure_delay, arg_min(slot, (d, slot)) AS best_departure FROM dep WHERE d IS NOT NULL GROUP BY origin),
best_arr AS (SELECT origin, min(d) AS best_arrival_delay, arg_min(slot, (d, slot)) AS best_arrival FROM arr WHERE d IS NOT NULL GROUP BY origin),
over AS (SELECT origin, count(*) FILTER (n * 1.5 / {DAY_CAP} > 1) AS over_windows FROM n GROUP BY origin)
SELECT origin, CAST(records AS BIGINT) AS records, {present('peak_before', 4)} AS peak_rli, over_windows, moved, {present('saved', 4)} AS saved,
       capacity >= peak AS demo_mode, best_departure, best_departure_delay, best_arrival, best_arrival_delay
FROM report JOIN best_dep USING (origin) JOIN best_arr USING (origin) JOIN over USING (origin)"""
)


def recommendations(spark, sf):
    return reports.recommendations(movements(spark, sf), CAP)


RECOMMENDATIONS_SQL = with_sql(
    f"""{influence_cte(False, 3, 'dep_delay_min')},
heavy AS (SELECT flight_id, sum(b * (1 + r)) AS total FROM node GROUP BY flight_id ORDER BY total DESC, flight_id LIMIT 3),
names AS (SELECT flight_id, arg_min({label_sql('flight_number')}, row_id) AS label FROM movements GROUP BY flight_id),
half AS (SELECT {bucket('sched_dep', 30)} AS slot, {present('avg(dep_delay_min)', 2)} AS d FROM movements GROUP BY 1),
n AS (SELECT {bucket('sched_dep', 5)} AS slot, count(*) AS n FROM movements GROUP BY 1)
SELECT 1 AS rule_id, 'Peak load index above 1.2: allow shifts of 20-30 min or leave a buffer around the peak slots.' AS message
FROM n HAVING max(n) * 1.5 / {CAP} > 1.2
UNION ALL
SELECT 2, 'Plan more departures near ' || strftime(arg_min(slot, (d, slot)), '%H:%M') || ', where the mean departure delay is lowest.'
FROM half WHERE d IS NOT NULL
UNION ALL
SELECT 3, 'Watch the turnarounds of high-impact flights: ' || string_agg(label, ', ' ORDER BY total DESC) || '.' FROM heavy JOIN names USING (flight_id)"""
)


# ---- questions ----------------------------------------------------------------------


def questions(spark, sf):
    return routing.classify(table(spark, sf, "conversations")).select("conv_id", "turn", "intent", "kind", "airport", "capacity")


def questions_with_help(spark, sf):
    talk = table(spark, sf, "conversations")
    return talk.groupBy(F.coalesce(routing.intent(F.col("text"), with_help=True), F.lit("none")).alias("intent")).agg(
        F.count(F.lit(1)).alias("questions")
    )


def document_intents(spark, sf):
    docs = table(spark, sf, "documents")
    return routing.classify(docs, default_airport="BLR").select("doc_id", "intent", "kind", "airport", "capacity")


def requests(spark, sf):
    return routing.distinct_requests(routing.classify(table(spark, sf, "conversations"), default_airport="BOM"))


def _has_sql(words):
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


_CAP = r"(?i)cap(?:acity)?\s*=?\s*([0-9]+)"
_INTENT = f"""CASE WHEN {_has_sql(routing.BUSIEST_WORDS)} THEN 'busiest'
  WHEN (contains(q, 'best') AND {_has_sql(routing.ARRIVAL_WORDS)}) OR contains(q, 'arrive') THEN 'best_arrival'
  WHEN (contains(q, 'best') AND {_has_sql(routing.DEPARTURE_WORDS)}) OR contains(q, 'take off') THEN 'best_departure'
  WHEN {_has_sql(routing.RLI_WORDS)} THEN 'rli' WHEN {_has_sql(routing.TUNER_WORDS)} THEN 'tuner'
  WHEN {_has_sql(routing.CASCADE_WORDS)} THEN 'cascade' WHEN {_has_sql(routing.WEATHER_WORDS)} THEN 'weather'
  WHEN {_has_sql(routing.CAPACITY_WORDS)} OR regexp_matches(q, '{_CAP}') THEN 'capacity'
  WHEN {_has_sql(routing.CONSOLIDATION_WORDS)} THEN 'consolidation'{{help}} END"""
_KIND = f"CASE WHEN {_has_sql(routing.KIND_WORDS['arrival'])} THEN 'arrival' WHEN {_has_sql(routing.KIND_WORDS['departure'])} THEN 'departure' END"
_CODE = r"nullif(regexp_extract(upper(text), '(^|[^\pL\pN_])(BOM|DEL)($|[^\pL\pN_])', 2), '')"
_CITY = r"lower(regexp_extract(text, '(?i)(^|[^\pL\pN_])(mumbai|bombay|new\s*delhi|delhi)($|[^\pL\pN_])', 2))"


def _classified(source, default="NULL::VARCHAR", help_rule=""):
    return f"""classified AS (
  SELECT *, {_INTENT.format(help=help_rule)} AS intent, {_KIND} AS kind,
         coalesce({_CODE}, CASE WHEN {_CITY} IN ('mumbai', 'bombay') THEN 'BOM' WHEN {_CITY} <> '' THEN 'DEL' ELSE {default} END) AS airport,
         coalesce(try_cast(regexp_extract(text, '{_CAP}', 1) AS BIGINT), 12) AS capacity
  FROM (SELECT *, lower(text) AS q FROM {source}))"""


_HELP = f" WHEN {_has_sql(routing.HELP_WORDS)} THEN 'help'"

CHECKS = {
    "move_priorities": (
        move_priorities,
        with_sql(f"""
SELECT row_id, {present('''abs(coalesce(dep_delay_min, 0)) * CASE WHEN carrier IN ('AI', '9W', '6E') THEN 2.0::DOUBLE ELSE 1 END
  * CASE WHEN hour(sched_dep) BETWEEN 6 AND 9 OR hour(sched_dep) BETWEEN 18 AND 21 THEN 1.5::DOUBLE ELSE 1 END
  * CASE WHEN tail_number IS NULL THEN 1 ELSE 1.2::DOUBLE END''', 4)} AS priority,
  CASE WHEN hour(sched_dep) IN (7, 8, 19, 20) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS relief FROM movements"""),
    ),
    "rotation_weights": (
        rotation_weights,
        with_sql("""
SELECT row_id, CASE WHEN act_arr IS NULL THEN 0.3 WHEN sched_dep < act_arr + INTERVAL 45 MINUTE THEN 0.9
                    WHEN sched_dep < act_arr + INTERVAL 90 MINUTE THEN 0.7 ELSE 0.4 END::DOUBLE AS weight FROM movements"""),
    ),
    "tuner_day": (tuner_day, TUNER_SQL),
    "tuner_of_airport": (tuner_of_airport, TUNER_AT_SQL),
    "tuner_timeline": (tuner_timeline, TIMELINE_SQL),
    "tuned_schedule_csv": (
        tuned_schedule_csv,
        _recursive(
            _replay(ONE)
            + f""",
names AS (SELECT flight_id, arg_min({label_sql('flight_number')}, row_id) AS label FROM day GROUP BY flight_id)
SELECT label AS flight_id, carrier, d.origin, strftime(sched_dep, '%Y-%m-%d %H:%M') AS scheduled_departure_before,
       strftime(coalesce(new_time, sched_dep), '%Y-%m-%d %H:%M') AS scheduled_departure_after
FROM day d JOIN names USING (flight_id) LEFT JOIN sugg s ON s.row_id = d.row_id"""
        ),
    ),
    "multi_objective": (multi_objective, MULTI_SQL),
    "tuned_times": (
        tuned_times,
        _recursive(_replay(ONE) + "\nSELECT row_id, coalesce(new_time, sched_dep) AS sched_dep_after FROM day LEFT JOIN sugg USING (row_id)"),
    ),
    "tuned_schedule": (
        tuned_schedule,
        _recursive(
            _replay(ONE)
            + """
SELECT d.row_id, d.flight_id, carrier, d.origin, strftime(sched_dep, '%Y-%m-%d %H:%M') AS scheduled_departure_before,
       strftime(coalesce(new_time, sched_dep), '%Y-%m-%d %H:%M') AS scheduled_departure_after
FROM day d LEFT JOIN sugg s ON s.row_id = d.row_id"""
        ),
    ),
    "tuned_by_flight_id": (
        tuned_by_flight_id,
        _recursive(
            _replay(ONE)
            + """,
last AS (SELECT flight_id, arg_max(new_time, (slot_start, slot_rank)) AS t FROM sugg GROUP BY flight_id)
SELECT row_id, coalesce(t, sched_dep) AS sched_dep_after FROM day LEFT JOIN last USING (flight_id)"""
        ),
    ),
    "tuned_slot_load": (tuned_slot_load, with_sql("SELECT origin, count(*) AS movements FROM movements GROUP BY origin")),
    "demo_capacity": (
        demo_capacity,
        with_sql(
            f""",
n AS (SELECT origin, {bucket('sched_dep', 5)} AS slot, count(*) AS n FROM day GROUP BY ALL)
SELECT origin, max(n) AS observed_peak, CASE WHEN max(n) <= 14 THEN greatest(1, max(n) - 1) ELSE 14 END AS cap, max(n) <= 14 AS demo_mode
FROM n GROUP BY origin""",
            DAY_SQL,
        ),
    ),
    "capacity_answer": (
        capacity_answer,
        with_sql(f""",
n AS (SELECT origin, {bucket('sched_dep', 5)} AS slot, count(*) * 1.5::DOUBLE / ({CAP} * 0.9::DOUBLE) AS load FROM movements GROUP BY ALL)
SELECT origin, {present('max(load)', 4)} AS peak_rli, count(*) FILTER (load > 1) AS overloaded_windows FROM n GROUP BY origin"""),
    ),
    "peak_next_hours": (
        peak_next_hours,
        with_sql(f""",
w AS (SELECT origin, count(*) FILTER (sched_dep >= TIMESTAMP '2024-01-15 09:30:00' AND sched_dep < TIMESTAMP '2024-01-15 11:30:00') > 0 AS busy,
             min(sched_dep) FILTER (sched_dep >= TIMESTAMP '2024-01-15 09:30:00') AS nxt FROM movements GROUP BY origin),
s AS (SELECT origin, busy, CASE WHEN busy THEN TIMESTAMP '2024-01-15 09:30:00' ELSE nxt END AS t FROM w),
n AS (SELECT origin, {bucket('sched_dep', 5)} AS slot, any_value(busy) AS busy, any_value(t) AS t, count(*) AS n FROM movements JOIN s USING (origin)
      WHERE sched_dep >= t AND sched_dep < t + INTERVAL 2 HOUR GROUP BY ALL)
SELECT origin, round(max(n) * 1.5 / {CAP}, 4) AS peak_rli, strftime(any_value(t), '%H:%M') || '–' || strftime(any_value(t) + INTERVAL 2 HOUR, '%H:%M')
       || CASE WHEN any_value(busy) THEN '' ELSE ' (next window)' END AS window_label FROM n GROUP BY origin"""),
    ),
    "scenario_load": (scenario_load, SCENARIO_LOAD_SQL),
    "compare_scenarios": (compare_scenarios, COMPARE_SQL),
    "tuner_kpis": (tuner_kpis, KPIS_SQL),
    "tuner_kpis_sparse": (tuner_kpis_sparse, KPIS_SPARSE_SQL),
    "ops_brief": (ops_brief, BRIEF_SQL),
    "ops_brief_csv": (ops_brief_csv, BRIEF_SQL),
    "insights": (insights, INSIGHTS_SQL),
    "recommendations": (recommendations, RECOMMENDATIONS_SQL),
    "questions": (questions, f"WITH {_classified('conversations')}\nSELECT conv_id, turn, intent, kind, airport, capacity FROM classified"),
    "questions_with_help": (
        questions_with_help,
        f"WITH {_classified('conversations', help_rule=_HELP)}\nSELECT coalesce(intent, 'none') AS intent, count(*) AS questions FROM classified GROUP BY 1",
    ),
    "document_intents": (
        document_intents,
        f"WITH {_classified('documents', repr('BLR'))}\nSELECT doc_id, intent, kind, airport, capacity FROM classified",
    ),
    "requests": (
        requests,
        f"""WITH {_classified('conversations', repr('BOM'))},
m AS (SELECT *, CASE WHEN intent = 'best_departure' AND kind = 'arrival' THEN 'best_arrival' WHEN intent <> 'weather' THEN intent END AS metric FROM classified)
SELECT metric, airport, CASE WHEN metric IN ('rli', 'tuner', 'cascade', 'capacity') THEN capacity END AS capacity, count(*) AS questions
FROM m WHERE metric IS NOT NULL GROUP BY ALL""",
    ),
}

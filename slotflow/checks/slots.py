"""Checks of slot counts, load index, best windows and consolidation."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import functions as F

from slotflow.checks.adapter import (
    MOVEMENTS_SQL,
    SPARSE_SQL,
    movements,
    movements_sparse,
    present,
    with_sql,
)
from slotflow.functions.scoring import present as present_column
from slotflow.operators import slots

BY = ["origin"]
CAP = 2  # the plain timeline holds few movements per slot


def rounded(df, *cols, digits=4):
    return df.withColumns({c: present_column(F.col(c), digits) + F.lit(0.0) for c in cols})


def bucket(expr: str, minutes: int) -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTE, {expr}, TIMESTAMP '1970-01-01')"


def dense_sql(source: str, minutes: int, by: str = "origin", time: str = "sched_dep", name: str = "dense") -> str:
    """CTEs giving {name}(by, slot_start, movements) on a contiguous axis."""
    return f"""
  {name}_n AS (SELECT {by}, {bucket(time, minutes)} AS slot_start, count(*) AS movements
               FROM {source} WHERE {time} IS NOT NULL GROUP BY ALL),
  {name}_axis AS (SELECT {by}, unnest(generate_series(min(slot_start), max(slot_start), INTERVAL {minutes} MINUTE)) AS slot_start
                  FROM {name}_n GROUP BY {by}),
  {name} AS (SELECT a.{by}, a.slot_start, coalesce(n.movements, 0) AS movements
             FROM {name}_axis a LEFT JOIN {name}_n n ON a.{by} = n.{by} AND a.slot_start = n.slot_start)"""


def busiest_slots(spark, sf):
    return slots.busiest_slots(movements(spark, sf), top_n=20)


BUSIEST_SQL = with_sql(f"""
SELECT {bucket('sched_dep', 15)} AS slot_start, count(*) AS movements
FROM movements GROUP BY 1 ORDER BY movements DESC, slot_start LIMIT 20""")


def slot_counts(spark, sf):
    return slots.slot_counts(movements(spark, sf), window_min=15, by=BY)


SLOT_COUNTS_SQL = with_sql(f"""
SELECT origin, {bucket('sched_dep', 15)} AS slot_start, count(*) AS movements FROM movements GROUP BY ALL""")


def busiest_slots_per_airport(spark, sf):
    return slots.busiest_slots(movements(spark, sf), top_n=10, by=BY)


BUSIEST_BY_SQL = with_sql(f"""
SELECT * FROM (SELECT origin, {bucket('sched_dep', 15)} AS slot_start, count(*) AS movements FROM movements GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY origin ORDER BY movements DESC, slot_start) <= 10""")


def _busiest_stats(key):
    def run(spark, sf):
        out = slots.busiest_slots_enhanced(movements(spark, sf), slot_key=key, top_n=20, by=BY)
        return rounded(out, "avg_per_day", "std_dev", "median_per_day", "margin_of_error", "ci_lower", "ci_upper")

    return run


def _busiest_stats_sql(key):
    slot = "slot" if key == "absolute" else "TIMESTAMP '1970-01-01' + (slot - date_trunc('day', slot))"
    return with_sql(f""",
daily AS (SELECT origin, {bucket('sched_dep', 15)} AS slot, count(*) AS daily FROM movements GROUP BY ALL),
seen AS (SELECT origin, {slot} AS slot_start, CAST(slot AS DATE) AS day, daily FROM daily),
numbered AS (SELECT *, row_number() OVER (PARTITION BY origin, slot_start ORDER BY day) - 1 AS x FROM seen),
stats AS (
  SELECT origin, slot_start, avg(daily) AS avg_per_day, stddev_samp(daily) AS std_dev, count(*) AS days_observed,
         median(daily) AS median_per_day, CAST(sum(daily) AS BIGINT) AS movements,
         CASE WHEN count(*) >= 3 THEN covar_samp(daily, x) END AS cov,
         CASE WHEN count(*) >= 3 THEN stddev_samp(x) * stddev_samp(daily) END AS sds
  FROM numbered GROUP BY origin, slot_start),
top AS (SELECT * REPLACE ({present('avg_per_day', 2)} AS avg_per_day, {present('std_dev', 2)} AS std_dev, {present('median_per_day', 2)} AS median_per_day)
        FROM stats QUALIFY row_number() OVER (PARTITION BY origin ORDER BY stats.movements DESC, slot_start) <= 20),
margins AS (SELECT *, 1.96 * std_dev / sqrt(days_observed) AS m FROM top)
SELECT origin, slot_start, round(avg_per_day, 4) AS avg_per_day, round(std_dev, 4) AS std_dev, days_observed,
       round(median_per_day, 4) AS median_per_day, movements, round(m, 4) AS margin_of_error,
       round(CASE WHEN m IS NOT NULL THEN greatest(avg_per_day - m, 0) END, 4) AS ci_lower, round(avg_per_day + m, 4) AS ci_upper,
       CASE WHEN m IS NOT NULL THEN printf('%.1f-%.1f', {present('greatest(avg_per_day - m, 0)', 1)}, {present('avg_per_day + m', 1)}) END
         AS confidence_interval,
       CASE WHEN days_observed < 3 THEN 'insufficient'
            WHEN sds > 0 AND abs(cov / sds) > 0.3 THEN CASE WHEN cov > 0 THEN 'increasing' ELSE 'decreasing' END
            ELSE 'stable' END AS trend
FROM margins""")


def runway_load_index(spark, sf):
    out = slots.runway_load_index(movements(spark, sf), ops_per_window_capacity=CAP, by=BY)
    return rounded(out, "rli")


RLI_SQL = with_sql(f""",{dense_sql('movements', 5)}
SELECT origin, slot_start, movements, round(movements * 1.5 / {CAP}, 4) AS rli FROM dense""")


def runway_load_index_all(spark, sf):
    out = slots.runway_load_index(movements(spark, sf), weather_factor=0.8, window_min=15, ops_per_window_capacity=3)
    return rounded(out, "rli")


RLI_ALL_SQL = with_sql(f""",
every AS (SELECT 1 AS k, sched_dep FROM movements),{dense_sql('every', 15, by='k')}
SELECT slot_start, movements, round(movements * 1.5 / (3 * 0.8 * 3), 4) AS rli FROM dense""")


def runway_load_index_enhanced(spark, sf):
    out = slots.runway_load_index_enhanced(
        movements(spark, sf), ops_per_window_capacity=CAP, weather_factor=0.9, by=BY
    )
    return rounded(out, "theoretical_capacity", "rli", "capacity_utilization_pct", "predicted_delay")


RLI_ENHANCED_SQL = with_sql(f""",{dense_sql('movements', 5)},
loaded AS (SELECT *, {CAP} * 0.9::DOUBLE AS cap, movements * 1.5::DOUBLE / ({CAP} * 0.9::DOUBLE) AS load FROM dense)
SELECT origin, slot_start, movements, round(load, 4) AS rli, round(cap, 4) AS theoretical_capacity,
       {present('movements / cap * 100', 1)} AS capacity_utilization_pct,
       CASE WHEN load > 1.1 THEN 'Critical' WHEN load > 0.9 THEN 'High' WHEN load > 0.7 THEN 'Medium'
            WHEN load > 0 THEN 'Low' END AS bottleneck_risk,
       CASE WHEN load <= 1 THEN 0.0::DOUBLE ELSE {present('(load - 1) * 50', 1)} END AS predicted_delay,
       round_even(greatest(movements - cap, 0), 0) AS estimated_queue_length
FROM loaded""")


def rli_resampled(spark, sf):
    rli = slots.runway_load_index(movements(spark, sf), ops_per_window_capacity=CAP, by=BY)
    return rounded(slots.resample_load(rli, 15, BY), "rli")


RESAMPLED_SQL = with_sql(f""",{dense_sql('movements', 5)}
SELECT origin, {bucket('slot_start', 15)} AS slot_start, CAST(sum(movements) AS BIGINT) AS movements,
       round(avg(movements * 1.5 / {CAP}), 4) AS rli
FROM dense GROUP BY ALL""")


def load_heatmap(spark, sf):
    rli = slots.runway_load_index(movements(spark, sf), ops_per_window_capacity=CAP, by=BY)
    return rounded(slots.load_heatmap(rli, BY), "max_rli", "avg_rli")


HEATMAP_SQL = with_sql(f""",{dense_sql('movements', 5)}
SELECT origin, CAST(slot_start AS DATE) AS date, hour(slot_start) AS hour,
       round(max(movements * 1.5 / {CAP}), 4) AS max_rli, round(avg(movements * 1.5 / {CAP}), 4) AS avg_rli
FROM dense GROUP BY ALL""")


def load_heatmap_wide(spark, sf):
    rli = slots.runway_load_index(movements(spark, sf), ops_per_window_capacity=CAP, by=BY)
    return rounded(slots.load_heatmap_wide(rli, BY), *[f"h{h:02d}" for h in range(24)])


_HOURS = ", ".join(f"round(max(movements * 1.5 / {CAP}) FILTER (hour(slot_start) = {h}), 4) AS h{h:02d}" for h in range(24))
HEATMAP_WIDE_SQL = with_sql(f""",{dense_sql('movements', 5)}
SELECT origin, CAST(slot_start AS DATE) AS date, {_HOURS} FROM dense GROUP BY origin, CAST(slot_start AS DATE)""")


def _best_time(kind, source, enhanced=True, by=BY):
    def run(spark, sf):
        if not enhanced:
            return slots.best_time_to_operate(source(spark, sf), kind=kind, by=by)
        return rounded(slots.best_time_to_operate_enhanced(source(spark, sf), kind=kind, by=by), "median_delay_min")

    return run


def _t_share(t: float, dof: int) -> float:
    """P(|T| < t) from the finite trigonometric sums for odd and even degrees of freedom."""
    angle = math.atan(t / math.sqrt(dof))
    c, s = math.cos(angle), math.sin(angle)
    term = total = c if dof % 2 else 1.0
    for k in range(3 if dof % 2 else 2, dof, 2):
        term *= c * c * (k - 1) / k
        total += term
    if dof % 2 == 0:
        return s * total
    return 2 / math.pi * (angle + (s * total if dof > 1 else 0.0))


@lru_cache(maxsize=4)
def t_values(confidence: float, up_to: int = 400) -> tuple[float, ...]:
    """Two-sided critical values by bisection, independent of the engine's."""
    found = []
    for dof in range(1, up_to + 1):
        low, high = 0.0, 1e4
        for _ in range(120):
            mid = (low + high) / 2
            low, high = (mid, high) if _t_share(mid, dof) < confidence else (low, mid)
        found.append((low + high) / 2)
    return tuple(found)


def _best_time_sql(kind, source, views, enhanced=True, minutes=30):
    time, delay = ("sched_arr", "arr_delay_min") if kind == "arrival" else ("sched_dep", "dep_delay_min")
    table = "[" + ", ".join(repr(v) for v in t_values(0.95)) + "]"
    axis = dense_sql(source, minutes, time=time)
    score = "CASE WHEN n >= 2 THEN 100 * (0.6 / (1 + std / greatest(mean, 0.1)) + 0.4 * ln(n) / ln(top)) END"
    cols = (
        "origin, slot_start, mean_delay_min, n"
        if not enhanced
        else f"origin, slot_start, mean_delay_min, {present('mean - coalesce(m, 0)', 2)} AS ci_lower, "
        f"{present('mean + coalesce(m, 0)', 2)} AS ci_upper, {present(score, 1)} AS reliability_score, n, "
        "round(med, 4) + 0.0 AS median_delay_min"
    )
    return with_sql(
        f""",{axis},
few AS (SELECT origin, count({delay}) < greatest(5, 0.1 * count(*)) AS sparse FROM {source} WHERE {time} IS NOT NULL GROUP BY origin),
used AS (SELECT s.origin, {bucket(time, minutes)} AS slot_start, CASE WHEN sparse THEN coalesce({delay}, 0) ELSE {delay} END AS d
         FROM {source} s JOIN few USING (origin) WHERE {time} IS NOT NULL),
stats AS (SELECT origin, slot_start, avg(d) AS mean, CASE WHEN count(d) > 1 THEN stddev_samp(d) END AS std, count(d) AS n, median(d) AS med
          FROM used GROUP BY ALL),
full_axis AS (SELECT a.origin, a.slot_start, s.mean, s.std, coalesce(s.n, 0) AS n, s.med,
                max(s.n) OVER (PARTITION BY a.origin) AS top, {present('s.mean', 2)} AS mean_delay_min
         FROM dense a LEFT JOIN stats s ON a.origin = s.origin AND a.slot_start = s.slot_start),
margins AS (SELECT *, CASE WHEN n > 1 THEN {table}[n - 1] END
                      * std / sqrt(n) AS m FROM full_axis)
SELECT {cols} FROM margins""",
        views,
    )


def best_at_airport(spark, sf):
    return slots.best_time_to_operate(movements(spark, sf), at_airport="del", kind="departure")


def consolidation(spark, sf):
    return slots.consolidation(movements(spark, sf), by=BY)


CONSOLIDATION_SQL = with_sql(f""",{dense_sql('movements', 60)},
rolled AS (
  SELECT *, CASE WHEN count(*) OVER two = 2 THEN sum(movements) OVER two END AS b2,
            CASE WHEN count(*) OVER three = 3 THEN sum(movements) OVER three END AS b3
  FROM dense WINDOW two AS (PARTITION BY origin ORDER BY slot_start ROWS 1 PRECEDING),
                    three AS (PARTITION BY origin ORDER BY slot_start ROWS 2 PRECEDING)),
wide AS (
  SELECT origin, sum(movements)::DOUBLE AS total_departures, max(movements)::DOUBLE AS max_in_any_hour,
         {present('max(b2) * 100.0::DOUBLE / sum(movements)', 1)} AS "share_top_2h_block_%",
         {present('max(b3) * 100.0::DOUBLE / sum(movements)', 1)} AS "share_top_3h_block_%"
  FROM rolled GROUP BY origin)
SELECT origin, metric, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE origin) INTO NAME metric VALUE value)""")

BEST_AT_SQL = (
    "SELECT slot_start, mean_delay_min, n FROM ("
    + _best_time_sql("departure", "movements", MOVEMENTS_SQL, enhanced=False)
    + ") WHERE origin = 'DEL'"
)

CHECKS = {
    "best_at_airport": (best_at_airport, BEST_AT_SQL),
    "slot_counts": (slot_counts, SLOT_COUNTS_SQL),
    "busiest_slots": (busiest_slots, BUSIEST_SQL),
    "busiest_slots_per_airport": (busiest_slots_per_airport, BUSIEST_BY_SQL),
    "busiest_slots_stats_absolute": (_busiest_stats("absolute"), _busiest_stats_sql("absolute")),
    "busiest_slots_stats_clock": (_busiest_stats("clock"), _busiest_stats_sql("clock")),
    "runway_load_index": (runway_load_index, RLI_SQL),
    "runway_load_index_all": (runway_load_index_all, RLI_ALL_SQL),
    "runway_load_index_enhanced": (runway_load_index_enhanced, RLI_ENHANCED_SQL),
    "rli_resampled": (rli_resampled, RESAMPLED_SQL),
    "load_heatmap": (load_heatmap, HEATMAP_SQL),
    "load_heatmap_wide": (load_heatmap_wide, HEATMAP_WIDE_SQL),
    "best_departure": (
        _best_time("departure", movements, enhanced=False),
        _best_time_sql("departure", "movements", MOVEMENTS_SQL, enhanced=False),
    ),
    "best_departure_enhanced": (
        _best_time("departure", movements),
        _best_time_sql("departure", "movements", MOVEMENTS_SQL),
    ),
    "best_arrival_enhanced": (
        _best_time("arrival", movements),
        _best_time_sql("arrival", "movements", MOVEMENTS_SQL),
    ),
    "best_arrival_sparse_delays": (
        _best_time("arrival", movements_sparse),
        _best_time_sql("arrival", "movements_sparse", SPARSE_SQL),
    ),
    "consolidation": (consolidation, CONSOLIDATION_SQL),
}

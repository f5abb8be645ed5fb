"""Checks of batch answers: questions are written from the conversations, requests joined in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotflow.checks.adapter import MOVEMENTS_SQL, SPARSE_SQL, movements, movements_sparse, present, table, with_sql
from slotflow.checks.flow import IMPACTS, influence_cte
from slotflow.checks.planning import ONE, _classified, _recursive, _replay, movements_day
from slotflow.checks.slots import bucket, rounded
from slotflow.plans import answers, routing
from slotflow.session import cut_lineage

# what is asked, where, and with which capacity
_TEXT = """CASE (conv_id + turn) % 11 WHEN 0 THEN 'busiest slots' WHEN 1 THEN 'best time to arrive' WHEN 2 THEN 'best slots for departure'
  WHEN 3 THEN 'runway congestion' WHEN 4 THEN 'tuner suggestions' WHEN 5 THEN 'top cascading flights' WHEN 6 THEN 'what about a storm'
  WHEN 7 THEN 'is there room' WHEN 8 THEN 'hourly consolidation' WHEN 9 THEN 'take off or land' ELSE 'hello there' END
 || CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' in BOM' WHEN 2 THEN ' at mumbai' WHEN 3 THEN ' for New Delhi' ELSE ' around DEL' END
 || CASE conv_id % 4 WHEN 1 THEN concat(' capacity ', 1 + conv_id % 3) WHEN 2 THEN concat(' cap=', 2 + conv_id % 4) ELSE '' END"""


def asked(spark, sf, *metrics):
    """The questions of the given metrics (all of them, those without a metric too, when none is given)."""
    texts = cut_lineage(table(spark, sf, "conversations").selectExpr(f"{_TEXT} AS text"))
    if not metrics:
        return texts
    return routing.classify(texts).filter(routing.metric_intent().isin(*metrics)).select("text")


def _flat(out, *fields):
    named = [F.col(f"answer.{c}").alias("measure" if c == "metric" else c) for c in fields]
    return out.select("metric", "airport", "capacity", "questions", "place", *named)


def answers_slots(spark, sf):
    metrics = ["busiest", "best_arrival", "best_departure", "rli", "capacity", "consolidation"]
    out = answers.answers(asked(spark, sf, *metrics), movements(spark, sf))
    flat = _flat(out, "slot_start", "movements", "mean_delay_min", "n", "rli", "metric", "value", "peak_rli", "overloaded_windows")
    return rounded(flat, "rli", "peak_rli", digits=6)


_ASKED = f"asked AS (SELECT {_TEXT} AS text FROM conversations),\n{_classified('asked')}"
_REQUESTS = f"""{_ASKED},
meant AS (SELECT *, CASE WHEN intent = 'best_departure' AND kind = 'arrival' THEN 'best_arrival' WHEN intent <> 'weather' THEN intent END AS metric FROM classified),
requests AS (
  SELECT metric, airport, CASE WHEN metric IN ('rli', 'tuner', 'cascade', 'capacity') THEN capacity END AS capacity, count(*) AS questions,
         coalesce(airport, '') AS site FROM meant WHERE metric IS NOT NULL GROUP BY ALL)"""
_SITES = "(VALUES ('', 0), ('BOM', 1), ('DEL', 2)) s(site, k)"
_TOUCHES = "(s.site = '' OR contains(origin, s.site) OR contains(destination, s.site) OR contains(coalesce(airport, ''), s.site))"


def _best_sql(kind, site, time, delay):
    return f"""
best_{kind}_n AS (
  SELECT s.site, {bucket(time, 30)} AS slot_start, {present(f'avg({delay})', 2)} AS mean_delay_min, count({delay}) AS n
  FROM movements JOIN {_SITES} ON s.site = '' OR contains({site}, s.site) WHERE {time} IS NOT NULL GROUP BY ALL),
best_{kind} AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY mean_delay_min NULLS LAST, slot_start) AS place FROM best_{kind}_n
  QUALIFY place <= 10)"""


_NONE = {"slot_start": "TIMESTAMP", "movements": "BIGINT", "mean_delay_min": "DOUBLE", "n": "BIGINT", "rli": "DOUBLE", "measure": "VARCHAR", "value": "DOUBLE", "peak_rli": "DOUBLE", "overloaded_windows": "BIGINT"}


def _row(metric, source, fields, on="r.site = x.site"):
    picked = ", ".join(f"CAST({fields[c]} AS {t}) AS {c}" if c in fields else f"CAST(NULL AS {t}) AS {c}" for c, t in _NONE.items())
    return f"""SELECT r.metric, r.airport, r.capacity, r.questions, CAST(x.place AS BIGINT) AS place, {picked}
FROM requests r LEFT JOIN {source} x ON {on} WHERE r.metric = '{metric}'"""


_SLOTS_SQL = with_sql(f""",
{_REQUESTS},
seen AS (SELECT s.site, movements.* FROM movements JOIN {_SITES} ON {_TOUCHES}),
busy AS (SELECT site, {bucket('sched_dep', 15)} AS slot_start, count(*) AS n FROM seen GROUP BY ALL),
busiest AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, slot_start) AS place FROM busy QUALIFY place <= 10),
five AS (SELECT site, {bucket('sched_dep', 5)} AS slot_start, count(*) AS n FROM seen GROUP BY ALL),
axis AS (SELECT site, unnest(generate_series(min(slot_start), max(slot_start), INTERVAL 5 MINUTE)) AS slot_start FROM five GROUP BY site),
dense AS (
  SELECT a.site, a.slot_start, coalesce(f.n, 0) AS n, row_number() OVER (PARTITION BY a.site ORDER BY a.slot_start) AS place
  FROM axis a LEFT JOIN five f ON f.site = a.site AND f.slot_start = a.slot_start QUALIFY place <= 50),
loads AS (
  SELECT r.site, r.capacity, 1 AS place, coalesce(max(n * 1.5::DOUBLE / r.capacity), 0) AS peak, count(*) FILTER (n * 1.5::DOUBLE / r.capacity > 1) AS over
  FROM requests r LEFT JOIN five f ON f.site = r.site WHERE r.metric = 'capacity' GROUP BY r.site, r.capacity),
hours AS (SELECT site, {bucket('sched_dep', 60)} AS h, count(*) AS n FROM seen GROUP BY ALL),
hour_axis AS (SELECT site, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hours GROUP BY site),
filled AS (SELECT a.site, a.h, coalesce(b.n, 0) AS n FROM hour_axis a LEFT JOIN hours b ON a.site = b.site AND a.h = b.h),
blocks AS (
  SELECT site, n, CASE WHEN count(*) OVER two = 2 THEN sum(n) OVER two END AS n2, CASE WHEN count(*) OVER three = 3 THEN sum(n) OVER three END AS n3
  FROM filled WINDOW two AS (PARTITION BY site ORDER BY h ROWS 1 PRECEDING), three AS (PARTITION BY site ORDER BY h ROWS 2 PRECEDING)),
wide AS (SELECT site, sum(n) AS total, max(n) AS most, max(n2) AS n2, max(n3) AS n3 FROM blocks GROUP BY site),
shares AS (
  SELECT site, 1 AS place, 'total_departures' AS measure, total::DOUBLE AS value FROM wide
  UNION ALL SELECT site, 2, 'max_in_any_hour', most::DOUBLE FROM wide
  UNION ALL SELECT site, 3, 'share_top_2h_block_%', {present('n2 * 100.0::DOUBLE / total', 1)} FROM wide
  UNION ALL SELECT site, 4, 'share_top_3h_block_%', {present('n3 * 100.0::DOUBLE / total', 1)} FROM wide),
{_best_sql('arrival', 'destination', 'sched_arr', 'arr_delay_min')},
{_best_sql('departure', 'origin', 'sched_dep', 'dep_delay_min')}
{_row('busiest', 'busiest', {'slot_start': 'x.slot_start', 'movements': 'x.n'})}
UNION ALL {_row('best_arrival', 'best_arrival', {'slot_start': 'x.slot_start', 'mean_delay_min': 'x.mean_delay_min', 'n': 'x.n'})}
UNION ALL {_row('best_departure', 'best_departure', {'slot_start': 'x.slot_start', 'mean_delay_min': 'x.mean_delay_min', 'n': 'x.n'})}
UNION ALL {_row('rli', 'dense', {'slot_start': 'x.slot_start', 'movements': 'x.n', 'rli': present('x.n * 1.5::DOUBLE / r.capacity', 6)})}
UNION ALL {_row('capacity', 'loads', {'peak_rli': present('x.peak', 6), 'overloaded_windows': 'x.over'}, 'r.site = x.site AND r.capacity = x.capacity')}
UNION ALL {_row('consolidation', 'shares', {'measure': 'x.measure', 'value': 'x.value'})}""")


def answers_tuner(spark, sf):
    out = answers.answers(asked(spark, sf, "tuner"), movements_day(spark, sf))
    return _flat(out, "row_id", "flight_id", "old_time", "new_time", "shift_min", "slot_start")


_DAY_BY_SITE = f"""{MOVEMENTS_SQL},
{_REQUESTS},
day AS (
  SELECT movements.* REPLACE (TIMESTAMP '2024-02-01' + (sched_dep - date_trunc('day', sched_dep)) AS sched_dep, s.site AS origin)
  FROM movements JOIN {_SITES} ON s.site = '' OR contains(origin, s.site))"""
_CAPACITIES = "SELECT DISTINCT CAST(capacity AS VARCHAR) AS scenario, capacity, 1.0::DOUBLE AS weather, 15 AS max_shift FROM requests WHERE metric = 'tuner'"
_TUNER_SQL = _recursive(
    _replay(ONE, cases=_CAPACITIES)
    + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY origin, scenario ORDER BY slot_start, slot_rank) AS place FROM sugg)
SELECT r.metric, r.airport, r.capacity, r.questions, p.place, p.row_id, p.flight_id, p.old_time, p.new_time, CAST(p.shift_min AS BIGINT) AS shift_min, p.slot_start
FROM requests r LEFT JOIN placed p ON p.origin = r.site AND p.scenario = CAST(r.capacity AS VARCHAR) WHERE r.metric = 'tuner'""",
    _DAY_BY_SITE,
)


def answers_cascade(spark, sf):
    out = answers.answers(asked(spark, sf, "cascade"), movements(spark, sf))
    return rounded(_flat(out, "flight_id", *IMPACTS), *IMPACTS)


def answers_cascade_sparse(spark, sf):
    """Too few delays are known: they are estimated from the capacity of each request."""
    out = answers.answers(asked(spark, sf, "cascade"), movements_sparse(spark, sf))
    return rounded(_flat(out, "flight_id", *IMPACTS), *IMPACTS)


def _cascade_sql(views, source, base):
    by_site = views.replace(f"{source} AS (", "every_movement AS (", 1) if source == "movements" else f"{views.replace('movements AS (', 'all_movements AS (', 1).replace('FROM movements)', 'FROM all_movements)')}"
    origin = "every_movement" if source == "movements" else source
    return with_sql(
        f"""{influence_cte(True, 3, 'dep_delay_min')},
sized AS (SELECT *, count(*) OVER (PARTITION BY origin, {bucket('sched_dep', 5)}) AS size FROM node),
based AS (SELECT q.capacity, n.* REPLACE ({base} AS b) FROM sized n JOIN requests q ON q.site = n.origin AND q.metric = 'cascade'),
sums AS (
  SELECT origin, capacity, flight_id, {present('sum(b * (1 + r))', 4)} AS influence_delta_total_delay, {present('sum(b)', 4)} AS direct_impact,
         {present('sum(b * r)', 4)} AS cascading_impact, {present('avg(b * r / greatest(b, 0.1))', 4)} AS influence_ratio,
         row_number() OVER (PARTITION BY origin, capacity ORDER BY round(sum(b * (1 + r)), 9) DESC, flight_id) AS place
  FROM based GROUP BY origin, capacity, flight_id)
SELECT r.metric, r.airport, r.capacity, r.questions, x.place, flight_id, {', '.join(IMPACTS)}
FROM requests r LEFT JOIN sums x ON x.origin = r.site AND x.capacity = r.capacity AND x.place <= 20 WHERE r.metric = 'cascade'""",
        f"""{by_site},
movements AS (SELECT {origin}.* REPLACE (row_id * 4 + s.k AS row_id, s.site AS origin) FROM {origin} JOIN {_SITES} ON {_TOUCHES}),
{_REQUESTS}""",
    )


CHECKS = {
    "answers_slots": (answers_slots, _SLOTS_SQL),
    "answers_tuner": (answers_tuner, _TUNER_SQL),
    "answers_cascade": (answers_cascade, _cascade_sql(MOVEMENTS_SQL, "movements", "n.b")),
    "answers_cascade_sparse": (
        answers_cascade_sparse,
        _cascade_sql(SPARSE_SQL, "movements_sparse", "coalesce(greatest(n.size - q.capacity, 0) * 3.0::DOUBLE, 0)"),
    ),
}

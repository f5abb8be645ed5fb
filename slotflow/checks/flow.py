"""Checks of scoping, delay logic, dependency edges and influence."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from slotflow.checks.adapter import (
    AIRPORT_ONLY_SQL,
    MOVEMENTS_SQL,
    SPARSE_SQL,
    movements,
    movements_airport_only,
    movements_sparse,
    present,
    with_sql,
)
from slotflow.checks.slots import BY, CAP, bucket, rounded
from slotflow.operators import delays, influence, scope, slots

AS_OF = datetime(2024, 1, 15, 9, 30, 20)


def _scope(mode, airport, source=movements, on_empty="none"):
    def run(spark, sf):
        return scope.scope_airport(source(spark, sf), airport, mode, on_empty).select("row_id", "origin", "destination", "airport")

    return run


SITE_COLS = "row_id, origin, destination, airport"


def filter_dates(spark, sf):
    return scope.filter_dates(movements(spark, sf), date(2024, 1, 20), date(2024, 1, 8)).select("row_id", "date")


def ensure_date(spark, sf):
    blank = movements(spark, sf).withColumns({"date": F.lit(None).cast("date"), "sched_dep": F.lit(None).cast("timestamp_ntz")})
    return scope.ensure_date(blank, date(2024, 2, 1)).select("row_id", "date")


def ops_view(spark, sf):
    return scope.ops_view(movements(spark, sf), date(2024, 2, 1)).select("row_id", "sched_dep")


def schedule_time(spark, sf):
    blank = movements(spark, sf).withColumn("sched_dep", F.lit(None).cast("timestamp_ntz"))
    return scope.schedule_time(blank).select("row_id", "sched_dep")


def primary_time(spark, sf):
    late = F.when(F.col("dep_delay_min").isNotNull(), F.col("sched_dep"))
    return movements(spark, sf).withColumn("sched_dep", late).select("row_id", scope.primary_time().alias("primary_time"))


def load_summary(spark, sf):
    from slotflow.sources.sinks import load_summary

    return load_summary(movements(spark, sf))


def column_presence(spark, sf):
    found = scope.presence(movements(spark, sf))
    return spark.range(1).select(*[F.lit(found[c]).alias(c) for c in PRESENCE_COLS])


PRESENCE_COLS = (
    "row_id flight_id date carrier flight_number origin destination airport tail_number gate sched_dep act_dep "
    "sched_arr act_arr dep_delay_min arr_delay_min"
).split()


def next_two_hours(spark, sf):
    out = scope.next_hours(movements(spark, sf), AS_OF, by=BY)
    return out.select("origin", "row_id", "sched_dep", "win_start", "win_end", "from_now")


NEXT_SQL_CTE = """,
windows AS (
  SELECT origin, coalesce(min(sched_dep) FILTER (sched_dep >= TIMESTAMP '2024-01-15 09:30:00'), min(sched_dep)) AS nxt,
         count(*) FILTER (sched_dep >= TIMESTAMP '2024-01-15 09:30:00' AND sched_dep < TIMESTAMP '2024-01-15 11:30:00') > 0 AS from_now
  FROM movements GROUP BY origin),
ahead AS (
  SELECT m.*, CASE WHEN from_now THEN TIMESTAMP '2024-01-15 09:30:00' ELSE nxt END AS win_start, from_now
  FROM movements m JOIN windows USING (origin))"""


def filled_delays(spark, sf):
    return delays.fill_sparse_delays(movements_sparse(spark, sf), "dep_delay_min", BY).select("row_id", "origin", "delay_used")


def synthetic_delays(spark, sf):
    out = delays.ensure_delay_metric(movements_sparse(spark, sf), CAP, 5, BY)
    return out.select("row_id", "origin", "dep_delay_min", "used_fallback")


def kept_delays(spark, sf):
    out = delays.ensure_delay_metric(movements(spark, sf), CAP)
    return rounded(out.select("row_id", "dep_delay_min", "used_fallback"), "dep_delay_min")


def total_delay_of_shifted(spark, sf):
    df = movements(spark, sf)
    later = df.select("origin", (F.col("sched_dep") + F.expr("INTERVAL 10 MINUTES")).alias("sched_dep"))
    return rounded(delays.estimate_total_dep_delay(df, later, by=BY), "total_dep_delay")


def delay_propagation(spark, sf):
    out = delays.delay_propagation_analysis(movements(spark, sf), 2, BY, limit=None)
    return rounded(out, "initial_delay", "avg_delay_propagation")


def delay_propagation_all(spark, sf):
    return rounded(delays.delay_propagation_analysis(movements(spark, sf), 2, limit=None), "initial_delay", "avg_delay_propagation")


def delay_propagation_first(spark, sf):
    return rounded(delays.delay_propagation_analysis(movements(spark, sf)), "initial_delay", "avg_delay_propagation")


def delay_propagation_first_per_airport(spark, sf):
    return rounded(delays.delay_propagation_analysis(movements(spark, sf), by=BY), "initial_delay", "avg_delay_propagation")


def _propagation_sql(by, limit=""):
    part, col = ("PARTITION BY origin", "origin, ") if by else ("", "")
    return with_sql(f""",
timed AS (SELECT {col}row_id, flight_id, sched_dep, coalesce(dep_delay_min, 0) AS d FROM movements),
ahead AS (
  SELECT *, avg(d) OVER w AS mean_d, count(*) OVER w AS n, count(*) FILTER (d > 5) OVER w AS late FROM timed
  WINDOW w AS ({part} ORDER BY sched_dep RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 2 HOUR FOLLOWING))
SELECT {col}row_id, flight_id AS initiating_flight, {present('d', 4)} AS initial_delay, sched_dep AS time_window_start,
       {present('least(d * 0.1, mean_d)', 4)} AS avg_delay_propagation, late AS affected_flights, n AS total_future_flights
FROM ahead WHERE d > 5 AND n > 0 {limit}""")


def movement_uid(spark, sf):
    return influence.movement_uid(movements(spark, sf)).select("row_id", "uid")


def dependency_edges(spark, sf):
    return rounded(influence.dependency_edges(movements(spark, sf), by=BY), "weight", digits=6)


def effective_edges(spark, sf):
    edges = influence.dependency_edges(movements(spark, sf), by=BY)
    return rounded(influence.effective_edges(edges), "weight", digits=6)


def _crew(incoming):
    def run(spark, sf):
        return rounded(influence.crew_links(movements(spark, sf), incoming), "weight_sum")

    return run


def _crew_sql(incoming):
    me, other = ("b", "a") if incoming else ("a", "b")
    return with_sql(f"""
SELECT {me}.row_id, count(*) AS links,
       round(sum(0.4 * greatest(0, 1 - (date_diff('second', a.sched_dep, b.sched_dep) / 3600.0::DOUBLE - 2) / 4)), 4) + 0.0 AS weight_sum
FROM movements a JOIN movements b ON a.carrier = b.carrier
 AND b.sched_dep BETWEEN a.sched_dep + INTERVAL 2 HOUR AND a.sched_dep + INTERVAL 6 HOUR
GROUP BY {me}.row_id""").replace(
        f"GROUP BY {me}.row_id", f"GROUP BY {me}.row_id\nUNION ALL\n"
        f"SELECT row_id, 0, 0.0 FROM movements m WHERE NOT EXISTS (SELECT 1 FROM movements o WHERE o.carrier = m.carrier AND "
        + ("o.sched_dep BETWEEN m.sched_dep - INTERVAL 6 HOUR AND m.sched_dep - INTERVAL 2 HOUR)" if incoming
           else "o.sched_dep BETWEEN m.sched_dep + INTERVAL 2 HOUR AND m.sched_dep + INTERVAL 6 HOUR)")
    )


def _raw_edges_cte(by):
    p = "origin, " if by else ""
    return f"""
m AS (SELECT *, coalesce(sched_dep, sched_arr) AS t, {bucket('coalesce(sched_dep, sched_arr)', 5)} AS slot FROM movements),
rotation AS (
  SELECT row_id AS src, lead(row_id) OVER w AS dst, 'rotation' AS kind, date_diff('second', sched_arr, lead(sched_dep) OVER w) / 60.0::DOUBLE AS turn
  FROM m WHERE tail_number IS NOT NULL WINDOW w AS (PARTITION BY {p}tail_number ORDER BY sched_dep NULLS LAST, row_id)),
queue AS (
  SELECT row_id AS src, unnest([lead(row_id, 1) OVER w, lead(row_id, 2) OVER w, lead(row_id, 3) OVER w]) AS dst, unnest([0.3, 0.24, 0.192]) AS weight
  FROM m WHERE t IS NOT NULL WINDOW w AS (PARTITION BY {p}slot ORDER BY sched_dep NULLS LAST, row_id)),
gate_pairs AS (
  SELECT row_id AS src, lead(row_id) OVER w AS dst FROM m WHERE gate IS NOT NULL
  WINDOW w AS (PARTITION BY {p}gate ORDER BY sched_dep NULLS LAST, row_id)),
explicit AS (
  SELECT src, dst, kind, CASE WHEN turn IS NULL THEN 0.3 WHEN turn < 45 THEN 0.9 WHEN turn < 90 THEN 0.7 ELSE 0.4 END::DOUBLE AS weight, 1 AS rank
  FROM rotation WHERE dst IS NOT NULL
  UNION ALL SELECT src, dst, 'runway', weight::DOUBLE, 2 FROM queue WHERE dst IS NOT NULL
  UNION ALL SELECT src, dst, 'gate', 0.35::DOUBLE, 3 FROM gate_pairs WHERE dst IS NOT NULL),
crew AS (
  SELECT a.row_id AS src, b.row_id AS dst, 'crew' AS kind,
         0.4 * greatest(0, 1 - (date_diff('second', a.sched_dep, b.sched_dep) / 3600.0::DOUBLE - 2) / 4) AS weight, 4 AS rank
  FROM m a JOIN m b ON a.carrier = b.carrier {'AND a.origin = b.origin' if by else ''}
   AND b.sched_dep BETWEEN a.sched_dep + INTERVAL 2 HOUR AND a.sched_dep + INTERVAL 6 HOUR)"""


EDGES_SQL = with_sql(f""",{_raw_edges_cte(True)}
SELECT e.src, e.dst, e.kind, round(e.weight, 6) AS weight, c.src IS NOT NULL AS crew_linked
FROM explicit e LEFT JOIN crew c ON e.src = c.src AND e.dst = c.dst""")

EFFECTIVE_SQL = with_sql(f""",{_raw_edges_cte(True)},
every AS (SELECT * FROM explicit UNION ALL SELECT * FROM crew),
best AS (SELECT src, dst, arg_max(weight, rank) AS weight, arg_max(kind, rank) AS kind FROM every GROUP BY src, dst)
SELECT src, dst, round(weight, 6) AS weight, kind FROM best WHERE kind <> 'crew'""")


def influence_cte(by, steps, base, direction="incoming"):
    """CTEs up to node(..., b, r): the base delay and the summed path weight of each movement."""
    out_, in_ = ("src", "dst") if direction == "incoming" else ("dst", "src")
    rounds, reach, decay = [], [], 1.0
    for k in range(1, steps + 1):
        decay *= 0.85
        source = (
            f"SELECT {in_} AS row_id, sum(weight) AS s FROM links GROUP BY {in_}"
            if k == 1
            else f"SELECT l.{in_} AS row_id, sum(l.weight * p.s) AS s FROM links l JOIN s{k - 1} p ON l.{out_} = p.row_id GROUP BY l.{in_}"
        )
        rounds.append(f"s{k} AS ({source})")
        reach.append(f"SELECT row_id, s * {decay!r} AS r FROM s{k}")
    return f""",{_raw_edges_cte(by)},
every AS (SELECT * FROM explicit UNION ALL SELECT * FROM crew),
links AS (SELECT src, dst, arg_max(weight, rank) AS weight FROM every GROUP BY src, dst),
{", ".join(rounds)},
reach AS (SELECT row_id, sum(r) AS r FROM ({" UNION ALL ".join(reach)}) GROUP BY row_id),
node AS (SELECT m.*, greatest(coalesce({base}, 0), 0) AS b, coalesce(r, 0) AS r FROM movements m LEFT JOIN reach USING (row_id))"""


def _influence_sql(by, steps, base, direction="incoming"):
    cols = "origin, " if by else ""
    return with_sql(f"""{influence_cte(by, steps, base, direction)}
SELECT {cols}flight_id, {present("sum(b * (1 + r))", 4)} AS influence_delta_total_delay, {present("sum(b)", 4)} AS direct_impact,
       {present("sum(b * r)", 4)} AS cascading_impact, {present("avg(b * r / greatest(b, 0.1))", 4)} AS influence_ratio
FROM node GROUP BY {cols}flight_id""")


IMPACTS = ["influence_delta_total_delay", "direct_impact", "cascading_impact", "influence_ratio"]


def influence_per_airport(spark, sf):
    out = influence.influence_table_enhanced(movements(spark, sf), "arr_delay_min", steps=4, by=BY)
    return rounded(out, *IMPACTS)


def influence_all(spark, sf):
    return rounded(influence.influence_table(movements(spark, sf), "dep_delay_min"), *IMPACTS)


def influence_outgoing(spark, sf):
    out = influence.influence_table_enhanced(movements(spark, sf), "dep_delay_min", steps=3, direction="outgoing", by=BY)
    return rounded(out, *IMPACTS)


def influence_of_airport(spark, sf):
    """All movements that touch one airport, as the source of a single table."""
    out = influence.influence_table(movements(spark, sf), "dep_delay_min", airport="bom")
    return rounded(out, *IMPACTS)


def at_airport_sql(condition: str) -> str:
    """The view ``movements`` narrowed to one airport."""
    return MOVEMENTS_SQL.replace("movements AS (", "every_movement AS (", 1) + f",\nmovements AS (SELECT * FROM every_movement WHERE {condition})"


CHECKS = {
    "scope_departures": (_scope("departure", "bom"), with_sql(f"SELECT {SITE_COLS} FROM movements WHERE origin LIKE '%BOM%'")),
    "scope_arrivals": (_scope("arrival", "DEL"), with_sql(f"SELECT {SITE_COLS} FROM movements WHERE destination LIKE '%DEL%'")),
    "scope_any": (
        _scope("any", "HYD"),
        with_sql(f"SELECT {SITE_COLS} FROM movements WHERE 'HYD' IN (origin, destination)"),
    ),
    "scope_any_or_all": (_scope("any", "XXX", on_empty="all"), with_sql(f"SELECT {SITE_COLS} FROM movements")),
    "scope_origin_first": (
        _scope("origin_first", "MAA", movements_airport_only),
        with_sql(f"SELECT {SITE_COLS} FROM movements_airport_only WHERE airport = 'MAA'", AIRPORT_ONLY_SQL),
    ),
    "scope_site_fallback": (
        _scope("departure", "BLR", movements_airport_only),
        with_sql(f"SELECT {SITE_COLS} FROM movements_airport_only WHERE airport = 'BLR'", AIRPORT_ONLY_SQL),
    ),
    "filter_dates": (
        filter_dates,
        with_sql("SELECT row_id, date FROM movements WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-20'"),
    ),
    "ensure_date": (ensure_date, with_sql("SELECT row_id, CAST(sched_arr AS DATE) AS date FROM movements")),
    "ops_view": (
        ops_view,
        with_sql("SELECT row_id, TIMESTAMP '2024-02-01' + (sched_dep - date_trunc('day', sched_dep)) AS sched_dep FROM movements"),
    ),
    "schedule_time": (
        schedule_time,
        with_sql("SELECT row_id, coalesce(act_dep, sched_arr) AS sched_dep FROM movements WHERE coalesce(act_dep, sched_arr) IS NOT NULL"),
    ),
    "primary_time": (
        primary_time,
        with_sql("SELECT row_id, CASE WHEN dep_delay_min IS NOT NULL THEN sched_dep ELSE sched_arr END AS primary_time FROM movements"),
    ),
    "column_presence": (
        column_presence,
        with_sql("SELECT " + ", ".join(f"count({c}) > 0 AS {c}" for c in PRESENCE_COLS) + " FROM movements"),
    ),
    "load_summary": (
        load_summary,
        with_sql("SELECT count(*) AS row_count, min(sched_dep) AS first_dep, max(sched_dep) AS last_dep FROM movements"),
    ),
    "next_two_hours": (
        next_two_hours,
        with_sql(f"""{NEXT_SQL_CTE}
SELECT origin, row_id, sched_dep, win_start, win_start + INTERVAL 2 HOUR AS win_end, from_now FROM ahead
WHERE sched_dep >= win_start AND sched_dep < win_start + INTERVAL 2 HOUR"""),
    ),
    "fill_sparse_delays": (
        filled_delays,
        with_sql(
            """,
few AS (SELECT origin, count(dep_delay_min) < greatest(5, 0.1 * count(*)) AS sparse FROM movements_sparse GROUP BY origin)
SELECT row_id, origin, CASE WHEN sparse THEN coalesce(dep_delay_min, 0) ELSE dep_delay_min END AS delay_used
FROM movements_sparse JOIN few USING (origin)""",
            SPARSE_SQL,
        ),
    ),
    "synthetic_delays": (
        synthetic_delays,
        with_sql(
            f""",
few AS (SELECT origin, count(dep_delay_min) < greatest(5, 0.1 * count(*)) AS sparse FROM movements_sparse GROUP BY origin),
n AS (SELECT *, count(*) OVER (PARTITION BY origin, {bucket('sched_dep', 5)}) AS k FROM movements_sparse)
SELECT row_id, origin, CASE WHEN sparse THEN (3 * greatest(0, k - {CAP}))::DOUBLE ELSE dep_delay_min END AS dep_delay_min,
       sparse AS used_fallback FROM n JOIN few USING (origin)""",
            SPARSE_SQL,
        ),
    ),
    "kept_delays": (
        kept_delays,
        with_sql("SELECT row_id, round(dep_delay_min, 4) + 0.0 AS dep_delay_min, FALSE AS used_fallback FROM movements"),
    ),
    "total_delay_of_shifted": (
        total_delay_of_shifted,
        with_sql(f""",
mean AS (SELECT origin, {bucket('sched_dep', 5)} AS slot, coalesce(avg(dep_delay_min), 0) AS d FROM movements GROUP BY ALL)
SELECT m.origin, round(sum(coalesce(d, 0)), 4) AS total_dep_delay FROM movements m
LEFT JOIN mean ON mean.origin = m.origin AND mean.slot = {bucket("m.sched_dep + INTERVAL 10 MINUTE", 5)} GROUP BY m.origin"""),
    ),
    "delay_propagation": (delay_propagation, _propagation_sql(True)),
    "delay_propagation_all": (delay_propagation_all, _propagation_sql(False)),
    "delay_propagation_first_per_airport": (
        delay_propagation_first_per_airport,
        _propagation_sql(True, "QUALIFY row_number() OVER (PARTITION BY origin ORDER BY sched_dep, row_id) <= 20"),
    ),
    "delay_propagation_first": (delay_propagation_first, _propagation_sql(False, "ORDER BY sched_dep, row_id LIMIT 20")),
    "movement_uid": (
        movement_uid,
        with_sql(
            "SELECT row_id, flight_id || '_' || (row_number() OVER (PARTITION BY flight_id ORDER BY row_id) - 1) AS uid FROM movements"
        ),
    ),
    "dependency_edges": (dependency_edges, EDGES_SQL),
    "effective_edges": (effective_edges, EFFECTIVE_SQL),
    "crew_links_incoming": (_crew(True), _crew_sql(True)),
    "crew_links_outgoing": (_crew(False), _crew_sql(False)),
    "influence_per_airport": (influence_per_airport, _influence_sql(True, 4, "arr_delay_min")),
    "influence_all": (influence_all, _influence_sql(False, 3, "dep_delay_min")),
    "influence_of_airport": (
        influence_of_airport,
        _influence_sql(False, 3, "dep_delay_min").replace(MOVEMENTS_SQL.strip(), at_airport_sql("'BOM' IN (origin, destination)").strip(), 1),
    ),
    "influence_outgoing": (influence_outgoing, _influence_sql(True, 3, "dep_delay_min", "outgoing")),
}

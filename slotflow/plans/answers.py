"""A table of questions answered in bulk.

The requests behind the questions are data: a table of (metric, airport, capacity). Every
metric is computed once for all airports that questions may name, from slot histograms
that capacities are then joined to, so the number of jobs depends neither on the questions
nor on the capacities they state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotflow.functions.ordered import running
from slotflow.functions.times import slot_start
from slotflow.operators.delays import too_few
from slotflow.operators.influence import propagate
from slotflow.operators.scope import scope_conditions, with_group_stats
from slotflow.operators.slots import CONSOLIDATION_METRICS, add_load_index, best_time_to_operate, consolidation, dense_slots, slot_counts, top_slots
from slotflow.operators.tuner import assign_moves, plan_moves
from slotflow.plans.routing import AIRPORT_CODES, classify, distinct_requests
from slotflow.session import cut_lineage

#: What an answer row may hold; a metric fills its own fields.
FIELDS = {
    "slot_start": "timestamp_ntz",
    "movements": "bigint",
    "mean_delay_min": "double",
    "n": "bigint",
    "rli": "double",
    "row_id": "bigint",
    "flight_id": "string",
    "old_time": "timestamp_ntz",
    "new_time": "timestamp_ntz",
    "shift_min": "bigint",
    "influence_delta_total_delay": "double",
    "direct_impact": "double",
    "cascading_impact": "double",
    "influence_ratio": "double",
    "metric": "string",
    "value": "double",
    "peak_rli": "double",
    "overloaded_windows": "bigint",
}
_AT, _ALL = "__at", ""  # the airport of a view, and the view of requests without one


@dataclass(frozen=True)
class AnswerSettings:
    window_min_busiest: int = 15
    window_min_best: int = 30
    rli_window_min: int = 5
    weather_factor: float = 1.0
    max_shift_min: int = 15
    busiest_rows: int = 10
    best_rows: int = 10
    rli_rows: int = 50
    cascade_steps: int = 3
    cascade_decay: float = 0.85
    cascade_rows: int = 20


def answers(
    questions: DataFrame,
    movements: DataFrame,
    text_col: str = "text",
    airport: str | None = None,
    default_capacity: int = 12,
    settings: AnswerSettings = AnswerSettings(),
) -> DataFrame:
    """(metric, airport, capacity, questions, place, answer) of all distinct requests.

    ``answer`` is a struct of :data:`FIELDS`, ``place`` its rank within the request; a request
    without data has one row where both are NULL. ``capacity`` is NULL for metrics that do
    not depend on it. Questions without a metric have no request.
    """
    requests = cut_lineage(distinct_requests(classify(questions, text_col, airport, default_capacity))).withColumn(_AT, F.coalesce("airport", F.lit(_ALL)))
    scopes = scope_conditions(movements, sorted({*AIRPORT_CODES, *([airport] if airport else [])}))
    tables = {
        "busiest": _busiest,
        "best_arrival": _best("arrival"),
        "best_departure": _best("departure"),
        "rli": _rli,
        "capacity": _capacity,
        "consolidation": _consolidation,
        "tuner": _tuner,
        "cascade": _cascade,
    }
    parts = []
    for metric, table in tables.items():
        asked = requests.filter(F.col("metric") == metric)
        found = table(_Views(movements, scopes, asked), asked.select(_AT, "capacity"), settings)
        keys = [c for c in (_AT, "capacity") if c in found.columns]
        fields = F.struct(*[(F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
        rows = found.select(*keys, F.col("place").cast("bigint").alias("place"), fields.alias("answer"))
        parts.append(asked.join(rows, keys, "left").select("metric", "airport", "capacity", "questions", "place", "answer"))
    return reduce(DataFrame.unionByName, parts)


class _Views:
    """Movements by the airport of a request: a movement stands in every view that holds it."""

    def __init__(self, movements: DataFrame, scopes: Mapping[str, Mapping[str, Column]], asked: DataFrame) -> None:
        # one row for each known airport at most
        self.movements, self.scopes, self.asked = movements, scopes, F.broadcast(asked.select(_AT).distinct())

    def __call__(self, mode: str) -> DataFrame:
        held = F.array_compact(F.array(F.lit(_ALL), *[F.when(c[mode], F.lit(a)) for a, c in self.scopes.items()]))
        return self.movements.withColumn(_AT, F.explode(held)).join(self.asked, _AT, "left_semi")


def _first(df: DataFrame, order: Sequence[Column], rows: int | None = None, keys: Sequence[str] = (_AT,)) -> DataFrame:
    """The first rows of each request with their place; slot rows, bounded by the calendar."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed if rows is None else placed.filter(F.col("place") <= rows)


def _busiest(views: _Views, asked: DataFrame, s: AnswerSettings) -> DataFrame:
    counts = slot_counts(views("view"), "sched_dep", s.window_min_busiest, [_AT])
    return _first(top_slots(counts, s.busiest_rows, [_AT]), [F.desc("movements"), F.asc("slot_start")])


def _best(kind: str):
    def table(views: _Views, asked: DataFrame, s: AnswerSettings) -> DataFrame:
        windows = best_time_to_operate(views(kind), None, kind, s.window_min_best, [_AT])
        return _first(windows, [F.asc_nulls_last("mean_delay_min"), F.asc("slot_start")], s.best_rows)

    return table


def _rli(views: _Views, asked: DataFrame, s: AnswerSettings) -> DataFrame:
    slots = _first(dense_slots(views("view"), "sched_dep", s.rli_window_min, [_AT]), [F.asc("slot_start")], s.rli_rows)
    return add_load_index(slots.join(asked, _AT), s.rli_window_min, F.lit(float(s.weather_factor)), F.col("capacity").cast("double"))


def _capacity(views: _Views, asked: DataFrame, s: AnswerSettings) -> DataFrame:
    """Capacities meet how many slots there are of each fullness, not the slots."""
    slots = slot_counts(views("view"), "sched_dep", s.rli_window_min, [_AT])
    sizes = slots.groupBy(_AT, "movements").agg(F.count(F.lit(1)).alias("slots"))
    load = add_load_index(asked.join(sizes, _AT, "left"), s.rli_window_min, F.lit(float(s.weather_factor)), F.col("capacity").cast("double"))
    over = F.sum(F.when(F.col("rli") > 1.0, F.col("slots")).otherwise(F.lit(0)))
    return load.groupBy(_AT, "capacity").agg(F.coalesce(F.max("rli"), F.lit(0.0)).alias("peak_rli"), over.alias("overloaded_windows")).withColumn("place", F.lit(1))


def _consolidation(views: _Views, asked: DataFrame, s: AnswerSettings) -> DataFrame:
    return consolidation(views("view"), by=[_AT]).withColumn("place", F.array_position(F.array(*map(F.lit, CONSOLIDATION_METRICS)), F.col("metric")))


def _tuner(views: _Views, asked: DataFrame, s: AnswerSettings) -> DataFrame:
    """Islands of overloaded slots per request; movements are ranked once per airport."""
    timed = with_group_stats(views("origin_first"), [_AT], {"__scheduled": F.count("sched_dep") > 0})
    # only where no departure is scheduled at all, the actual departure or the arrival schedule
    timed = timed.withColumn("sched_dep", F.when(F.col("__scheduled"), F.col("sched_dep")).otherwise(F.coalesce("act_dep", "sched_arr"))).filter("sched_dep IS NOT NULL")
    slots = slot_counts(timed, "sched_dep", s.rli_window_min, [_AT]).join(asked, _AT)
    planned = slots.withColumns({"cap": F.col("capacity"), "max_shift": F.lit(s.max_shift_min).cast("bigint")})
    moves = cut_lineage(plan_moves(planned, s.rli_window_min, [_AT, "capacity"]))
    chosen = assign_moves(timed, moves, s.rli_window_min, [_AT], ["capacity"])
    return running(cut_lineage(chosen), [_AT, "capacity"], ["slot_start", "slot_rank"], {"place": F.lit(1)})


def _cascade(views: _Views, asked: DataFrame, s: AnswerSettings) -> DataFrame:
    """Paths do not depend on the capacity; delays do, where too few are known.

    Estimated delays are the same for all movements of a slot of one size, so capacities meet
    (flight, slot size) sums, not movements.
    """
    rows = views("any").withColumn("row_id", F.struct(_AT, "row_id"))  # a movement is another node in each view
    reach = propagate(rows, s.cascade_steps, s.cascade_decay, by=[_AT])
    sizes = slot_counts(rows, "sched_dep", s.rli_window_min, [_AT]).withColumnsRenamed({"slot_start": "__slot", "movements": "size"})
    known = with_group_stats(rows, [_AT], {"__sparse": too_few("dep_delay_min")}).withColumn("__slot", slot_start("sched_dep", s.rli_window_min))
    joined = known.join(sizes, [_AT, "__slot"], "left").join(reach, "row_id", "left")
    nodes = joined.select(_AT, "flight_id", "size", "__sparse", F.greatest(F.coalesce("dep_delay_min", F.lit(0.0)), F.lit(0.0)).alias("b"), F.coalesce("reach", F.lit(0.0)).alias("r"))

    def impacts(df: DataFrame, keys: list[str], rows: Column, b: Column, r: Column) -> DataFrame:
        """``rows`` movements with the base delay ``b`` each and the reach ``r`` together."""
        ratio = F.sum(b * r / F.greatest(b, F.lit(0.1))) / F.sum(rows)
        return df.groupBy(*keys, "flight_id").agg(
            F.sum(b * (rows + r)).alias("influence_delta_total_delay"), F.sum(b * rows).alias("direct_impact"), F.sum(b * r).alias("cascading_impact"), ratio.alias("influence_ratio")
        )

    def top(df: DataFrame, keys: list[str]) -> DataFrame:
        return _first(df, [F.desc("influence_delta_total_delay"), F.asc("flight_id")], s.cascade_rows, keys)

    given = top(impacts(nodes.filter(~F.col("__sparse")), [_AT], F.lit(1.0), F.col("b"), F.col("r")), [_AT]).join(asked, _AT)
    alike = nodes.filter("__sparse").groupBy(_AT, "flight_id", "size").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("r").alias("r"))
    estimate = F.coalesce(F.greatest(F.col("size") - F.col("capacity"), F.lit(0)) * 3.0, F.lit(0.0))
    keys = [_AT, "capacity"]
    estimated = top(impacts(alike.join(asked, _AT).withColumn("b", estimate), keys, F.col("rows"), F.col("b"), F.col("r")), keys)
    return given.unionByName(estimated)

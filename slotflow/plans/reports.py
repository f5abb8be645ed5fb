"""KPI rows, scenario comparison, recommendations and exports.

Movements are scanned once into slot rows; peaks, overloads, delay estimates and the
effect of tuning are all computed on those. Movements are read a second time only to
name the flights that move.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotflow.functions.scoring import effective_capacity, load_index
from slotflow.functions.times import slot_start
from slotflow.operators.delays import ensure_delay_metric
from slotflow.operators.influence import influence_table
from slotflow.operators.labels import show_labels
from slotflow.operators.scope import in_groups, next_hours, with_group_stats
from slotflow.operators.slots import add_load_index, best_time_to_operate, slot_counts
from slotflow.operators.tuner import (
    assign_moves,
    build_tuned_schedule,
    plan_moves,
    slots_after,
)
from slotflow.session import cut_lineage
from slotflow.sources.sinks import export_csv

OCCUPANCY_MIN = 1.5


@dataclass(frozen=True)
class Scenario:
    name: str
    capacity: int = 12
    weather: float = 1.0
    max_shift_min: int = 15


def attach_group(left: DataFrame, right: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Columns of the one row per group in ``right`` (one row in all when ``by`` is empty)."""
    if by:
        return left.join(right.select(*by, *columns), list(by), "left")
    one = right.select(F.struct(*columns).alias("s")).scalar()
    return left.withColumn("__s", one).select("*", *[F.col(f"__s.{c}").alias(c) for c in columns]).drop("__s")


def slot_profile(df: DataFrame, window_min: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, slot_start, movements, mean_delay, used_fallback): one pass over the movements."""
    profile = df.groupBy(*by, slot_start("sched_dep", window_min).alias("slot_start")).agg(
        F.count(F.lit(1)).alias("movements"),
        F.count("dep_delay_min").alias("__known"),
        F.avg("dep_delay_min").alias("mean_delay"),
    )
    sparse = F.sum("__known") < F.greatest(F.lit(5.0), F.sum("movements") * 0.1)
    return (
        with_group_stats(profile, by, {"used_fallback": sparse})
        .filter(F.col("slot_start").isNotNull())
        .drop("__known")
    )


def _delay_per_movement(capacity: Column) -> Column:
    """Mean delay of a slot, or the congestion estimate where delays are too few."""
    synthetic = F.greatest(F.col("movements") - capacity, F.lit(0)) * 3.0
    return F.when(F.col("used_fallback"), synthetic).otherwise(F.coalesce(F.col("mean_delay"), F.lit(0.0)))


def _with_scenarios(slots: DataFrame, scenarios: Iterable[Scenario]) -> DataFrame:
    cases = [
        F.struct(
            F.lit(s.name).alias("scenario"),
            F.lit(s.capacity).cast("bigint").alias("capacity"),
            F.lit(float(s.weather)).alias("weather"),
            F.lit(s.max_shift_min).cast("bigint").alias("max_shift"),
        )
        for s in scenarios
    ]
    return slots.withColumn("__c", F.explode(F.array(*cases))).select("*", "__c.*").drop("__c")


def tuning_report(
    df: DataFrame,
    scenarios: Sequence[Scenario],
    window_min: int = 5,
    by: Sequence[str] = (),
    demo: bool = False,
) -> DataFrame:
    """One row per scenario (and group): load, delay and moves before and after tuning.

    ``demo`` lowers a capacity that is never exceeded to one below the observed peak
    for the tuning itself; load indices keep the stated capacity.
    """
    keys = ["scenario", *by]
    df = in_groups(df, by)
    profile = cut_lineage(slot_profile(df, window_min, by))
    slots = _with_scenarios(profile, scenarios)
    if demo:
        peak = with_group_stats(slots, keys, {"observed_peak": F.max("movements")})
        never = F.col("capacity") >= F.col("observed_peak")
        slots = peak.withColumns(
            {
                "demo_mode": never,
                "cap": F.when(never, F.greatest(F.lit(1).cast("bigint"), F.col("observed_peak") - 1)).otherwise(
                    F.col("capacity")
                ),
            }
        )
    else:
        slots = slots.withColumns({"demo_mode": F.lit(False), "cap": F.col("capacity")})
    slots = slots.withColumn("delay", _delay_per_movement(F.col("capacity")))

    moves = cut_lineage(plan_moves(slots.select(*keys, "slot_start", "movements", "cap", "max_shift"), window_min, keys))
    after = slots_after(slots, moves, keys).join(
        slots.select(*keys, "slot_start", "delay"), [*keys, "slot_start"], "left"
    )
    moved = assign_moves(df, moves, window_min, by, ["scenario"])

    load = load_index(
        F.max("movements"), F.max(effective_capacity(F.col("capacity"), F.col("weather"), window_min)), OCCUPANCY_MIN
    )
    busy = load_index(
        F.col("movements"), effective_capacity(F.col("capacity"), F.col("weather"), window_min), OCCUPANCY_MIN
    )
    before_rows = slots.groupBy(*keys).agg(
        F.max("capacity").alias("capacity"),
        F.max("weather").alias("weather"),
        F.max("max_shift").alias("max_shift"),
        F.max("cap").alias("tuned_capacity"),
        F.bool_or("demo_mode").alias("demo_mode"),
        F.bool_or("used_fallback").alias("used_fallback"),
        F.sum("movements").alias("records"),
        F.max("movements").alias("observed_peak"),
        load.alias("peak_before"),
        F.count_if(busy > 1.0).alias("over_windows"),
        F.sum(F.col("movements") * F.col("delay")).alias("delay_before"),
    )
    after_rows = after.groupBy(*keys).agg(
        F.max("movements").alias("__peak"),
        F.sum(F.col("movements") * F.coalesce(F.col("delay"), F.lit(0.0))).alias("delay_after"),
    )
    size = F.col("rank_to") - F.col("rank_from") + 1
    shift_rows = moves.groupBy(*keys).agg(F.sum(size * F.abs("shift_min")).alias("minutes_shifted"))
    moved_rows = moved.groupBy(*keys).agg(F.count_distinct("flight_id").alias("moved"))
    merged = before_rows
    for part in (after_rows, shift_rows, moved_rows):
        merged = merged.join(part, keys, "left")

    cap = effective_capacity(F.col("capacity"), F.col("weather"), window_min)
    merged = merged.withColumns(
        {
            "peak_after": load_index(F.col("__peak"), cap, OCCUPANCY_MIN),
            "moved": F.coalesce("moved", F.lit(0).cast("bigint")),
            "minutes_shifted": F.coalesce("minutes_shifted", F.lit(0).cast("bigint")),
            "saved_min": F.col("delay_before") - F.col("delay_after"),
        }
    )
    none = F.lit(0.0)
    return merged.drop("__peak").withColumns(
        {
            "peak_drop": F.greatest(F.col("peak_before") - F.col("peak_after"), none),
            "avg_saved_per_flight": F.coalesce(F.try_divide(F.col("saved_min"), F.col("moved")), none),
            "efficiency": F.coalesce(F.try_divide(F.col("saved_min"), F.col("minutes_shifted")), none),
        }
    )


def compare_scenarios(
    df: DataFrame, scenarios: Sequence[Scenario], window_min: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """Scenarios side by side, the largest peak reduction first."""
    report = tuning_report(df, scenarios, window_min, by)
    return report.select(
        "scenario",
        *by,
        "capacity",
        "weather",
        "max_shift",
        "peak_before",
        "peak_after",
        "peak_drop",
        "moved",
        "saved_min",
    ).orderBy(F.desc("peak_drop"), "scenario", *by)


def tuner_kpis(df: DataFrame, scenario: Scenario, window_min: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Before and after indicators of one tuning run (capacity lowered for show if never exceeded)."""
    return tuning_report(df, [scenario], window_min, by, demo=True).select(
        *by,
        "peak_before",
        "peak_after",
        "peak_drop",
        "moved",
        F.col("saved_min").alias("delay_delta"),
        "avg_saved_per_flight",
        "minutes_shifted",
        "efficiency",
        "demo_mode",
        "used_fallback",
    )


def ops_brief(df: DataFrame, airport: str | None, scenario: Scenario, by: Sequence[str] = ()) -> DataFrame:
    """One exportable row per airport; ``airport`` names the whole frame when ``by`` is empty."""
    report = tuning_report(df, [scenario], 5, by, demo=True)
    name = F.concat_ws(" ", *by) if by else F.lit(airport)
    return report.select(
        name.alias("airport"),
        "capacity",
        F.col("weather").alias("weather_factor"),
        F.col("peak_before").alias("peak_rli_before"),
        F.col("peak_after").alias("peak_rli_after"),
        "peak_drop",
        F.col("moved").alias("flights_moved"),
        F.col("saved_min").alias("est_delay_saved_min"),
    )


def export_ops_brief(df: DataFrame, path: str, airport: str | None, scenario: Scenario, by: Sequence[str] = ()) -> str:
    return export_csv(ops_brief(df, airport, scenario, by), path)


def export_tuned_schedule(df: DataFrame, suggestions: DataFrame, path: str) -> str:
    """The schedule before and after tuning as CSV, with labels in place of flight ids."""
    return export_csv(show_labels(build_tuned_schedule(df, suggestions), df).drop("row_id"), path)


def best_window(df: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """The 30-min window with the lowest mean delay: (by, best_{kind}, best_{kind}_delay)."""
    table = best_time_to_operate(df, kind=kind, by=by).filter(F.col("mean_delay_min").isNotNull())
    order = F.struct("mean_delay_min", "slot_start")
    return table.groupBy(*by).agg(
        F.min_by("slot_start", order).alias(f"best_{kind}"), F.min("mean_delay_min").alias(f"best_{kind}_delay")
    )


def summarize_insights(df: DataFrame, scenario: Scenario, by: Sequence[str] = ()) -> DataFrame:
    """Header indicators of a view: records, peak, overload, best windows, moves, saved delay."""
    out = tuning_report(df, [scenario], 5, by, demo=True).select(
        *by,
        "records",
        F.col("peak_before").alias("peak_rli"),
        "over_windows",
        "moved",
        F.col("saved_min").alias("saved"),
        "demo_mode",
    )
    for kind in ("departure", "arrival"):
        best = best_window(df, kind, by)
        out = attach_group(out, best, [f"best_{kind}", f"best_{kind}_delay"], by)
    return out


def capacity_answer(
    df: DataFrame, capacity: int = 12, weather: float = 1.0, window_min: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """(by, peak_rli, overloaded_windows) at a given capacity."""
    rli = add_load_index(
        slot_counts(df, "sched_dep", window_min, by), window_min, F.lit(float(weather)), F.lit(float(capacity))
    )
    return rli.groupBy(*by).agg(
        F.coalesce(F.max("rli"), F.lit(0.0)).alias("peak_rli"), F.count_if(F.col("rli") > 1.0).alias("overloaded_windows")
    )


def peak_next_hours(
    df: DataFrame,
    as_of: datetime,
    capacity: int = 12,
    weather: float = 1.0,
    hours: int = 2,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, peak_rli, window_label) of the coming hours, or of the next busy ones."""
    clock = lambda c: F.date_format(c, "HH:mm")
    ahead = next_hours(df, as_of, hours, by=by)
    label = F.concat(
        clock("win_start"), F.lit("–"), clock("win_end"), F.when(F.col("from_now"), "").otherwise(" (next window)")
    )
    slots = ahead.groupBy(*by, slot_start("sched_dep", 5).alias("slot_start"), label.alias("window_label")).agg(
        F.count(F.lit(1)).alias("movements")
    )
    rli = add_load_index(slots, 5, F.lit(float(weather)), F.lit(float(capacity)))
    return rli.groupBy(*by).agg(F.max("rli").alias("peak_rli"), F.any_value("window_label").alias("window_label"))


def recommendations(df: DataFrame, capacity: int = 12, weather: float = 1.0) -> DataFrame:
    """(rule_id, message) rows that apply to the movements; a single ``balanced`` row if none does."""
    peak = capacity_answer(df, capacity, weather).filter(F.col("peak_rli") > 1.2)
    rows = peak.select(
        F.lit(1).alias("rule_id"),
        F.lit("Peak load index above 1.2: allow shifts of 20-30 min or leave a buffer around the peak slots.").alias("message"),
    )
    best = best_window(df, "departure").filter(F.col("best_departure").isNotNull())
    rows = rows.unionByName(
        best.select(
            F.lit(2).alias("rule_id"),
            F.format_string(
                "Plan more departures near %s, where the mean departure delay is lowest.",
                F.date_format("best_departure", "HH:mm"),
            ).alias("message"),
        )
    )
    heavy = influence_table(ensure_delay_metric(df, capacity), "dep_delay_min")
    top = heavy.orderBy(F.desc("influence_delta_total_delay"), "flight_id").limit(3)
    named = show_labels(top, df).agg(
        F.sort_array(F.collect_list(F.struct("influence_delta_total_delay", "flight_id")), asc=False).alias("t")
    )
    names = F.concat_ws(", ", F.transform("t", lambda x: x["flight_id"]))
    rows = rows.unionByName(
        named.filter(F.size("t") > 0).select(
            F.lit(3).alias("rule_id"),
            F.concat(F.lit("Watch the turnarounds of high-impact flights: "), names, F.lit(".")).alias("message"),
        )
    )
    rows = cut_lineage(rows)
    none = rows.agg(F.count(F.lit(1)) == 0).scalar()
    calm = df.sparkSession.createDataFrame(
        [(0, "The schedule looks balanced: stress it with weather 0.8 and two movements less per window.")],
        "rule_id int, message string",
    )
    return rows.unionByName(calm.filter(none)).orderBy("rule_id")

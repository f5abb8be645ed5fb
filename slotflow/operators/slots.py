"""Slot counts, busiest slots, runway load index and best operating windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotflow.functions import scoring
from slotflow.functions.ordered import gap_fill, value_stats
from slotflow.functions.quantiles import t_critical
from slotflow.functions.times import DAY, from_micros, micros, require_window, slot_start
from slotflow.operators.scope import scope_airport, with_group_stats


def slot_counts(df: DataFrame, time_col: str = "sched_dep", window_min: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """(by, slot_start, movements) for slots that have movements."""
    return (
        df.filter(F.col(time_col).isNotNull())
        .groupBy(*by, slot_start(time_col, window_min).alias("slot_start"))
        .agg(F.count(F.lit(1)).alias("movements"))
    )


def top_slots(counts: DataFrame, top_n: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``top_n`` fullest slots (per group), ties by time."""
    order = [F.desc("movements"), F.asc("slot_start")]
    if not by:
        return counts.orderBy(*order).limit(top_n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return counts.withColumn("__rank", rank).filter(F.col("__rank") <= top_n).drop("__rank")


def busiest_slots(
    df: DataFrame, time_col: str = "sched_dep", window_min: int = 15, top_n: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    return top_slots(slot_counts(df, time_col, window_min, by), top_n, by)


def busiest_slots_enhanced(
    df: DataFrame,
    time_col: str = "sched_dep",
    window_min: int = 15,
    top_n: int = 20,
    include_stats: bool = True,
    slot_key: str = "absolute",
    by: Sequence[str] = (),
) -> DataFrame:
    """Busiest slots with per-day statistics, interval and trend.

    ``slot_key="absolute"`` keeps the date in the slot, so each slot is seen on one
    day only; ``"clock"`` uses the time of day (anchored at 1970-01-01), where the
    statistics describe how the slot varies over days.
    """
    daily = (
        slot_counts(df, time_col, window_min, by)
        .withColumn("date", F.to_date("slot_start"))
        .withColumnRenamed("movements", "daily")
    )
    if slot_key == "clock":
        daily = daily.withColumn("slot_start", from_micros(F.pmod(micros("slot_start"), F.lit(DAY))))
    elif slot_key != "absolute":
        raise ValueError(f"slot_key must be 'absolute' or 'clock', not {slot_key!r}")
    group = [*by, "slot_start"]
    # one row per (slot, date): a group holds at most as many rows as there are days
    day_no = F.row_number().over(Window.partitionBy(*group).orderBy("date")) - 1
    y, x = F.col("daily").cast("double"), F.col("__x").cast("double")
    stats = (
        daily.withColumn("__x", day_no)
        .groupBy(*group)
        .agg(
            F.avg("daily").alias("avg_per_day"),
            F.stddev_samp("daily").alias("std_dev"),
            F.count(F.lit(1)).alias("days_observed"),
            F.median("daily").alias("median_per_day"),
            F.sum("daily").alias("movements"),
            F.regr_slope(y, x).alias("__slope"),
            F.covar_samp(y, x).alias("__cov"),
            (F.stddev_samp(x) * F.stddev_samp(y)).alias("__sds"),
        )
    )
    base = [*group, "avg_per_day", "std_dev", "days_observed", "median_per_day", "movements"]
    # Shown with two digits; what follows is computed from the shown values.
    stats = top_slots(stats, top_n, by).withColumns(
        {c: scoring.present(F.col(c), 2) for c in ("avg_per_day", "std_dev", "median_per_day")}
    )
    if not include_stats:
        return stats.select(*base)
    margin = F.lit(1.96) * F.col("std_dev") / F.sqrt(F.col("days_observed"))
    r = F.try_divide(F.col("__cov"), F.col("__sds"))
    trend = (
        F.when(F.col("days_observed") < 3, "insufficient")
        .when(F.abs(r) > 0.3, F.when(F.col("__slope") > 0, "increasing").otherwise("decreasing"))
        .otherwise("stable")
    )
    low = F.when(margin.isNotNull(), F.greatest(F.col("avg_per_day") - margin, F.lit(0.0)))
    high = F.col("avg_per_day") + margin
    text = F.when(margin.isNotNull(), F.format_string("%.1f-%.1f", scoring.present(low, 1), scoring.present(high, 1)))
    return stats.select(
        *base,
        margin.alias("margin_of_error"),
        low.alias("ci_lower"),
        high.alias("ci_upper"),
        text.alias("confidence_interval"),
        trend.alias("trend"),
    )


# ---- runway load index --------------------------------------------------------------


def dense_slots(
    df: DataFrame, time_col: str = "sched_dep", window_min: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """Slot counts from the first to the last slot of each group, empty slots as 0."""
    return gap_fill(slot_counts(df, time_col, window_min, by), by, "slot_start", window_min, zeros=["movements"])


def add_load_index(
    slots: DataFrame, window_min: int, weather: Column, capacity: Column, occ_per_flight_min: float = 1.5
) -> DataFrame:
    """``rli`` of slot rows; capacity and weather may be columns (scenarios)."""
    cap = scoring.effective_capacity(capacity, weather, window_min)
    return slots.withColumn("rli", scoring.load_index(F.col("movements"), cap, occ_per_flight_min))


def runway_load_index(
    df: DataFrame,
    time_col: str = "sched_dep",
    window_min: int = 5,
    weather_factor: float = 1.0,
    ops_per_window_capacity: int = 12,
    occ_per_flight_min: float = 1.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, slot_start, movements, rli) on a contiguous slot axis."""
    return add_load_index(
        dense_slots(df, time_col, window_min, by),
        window_min,
        F.lit(float(weather_factor)),
        F.lit(float(ops_per_window_capacity)),
        occ_per_flight_min,
    )


def runway_load_index_enhanced(
    df: DataFrame,
    time_col: str = "sched_dep",
    window_min: int = 5,
    weather_factor: float = 1.0,
    ops_per_window_capacity: int = 12,
    occ_per_flight_min: float = 1.5,
    include_predictions: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Load index with capacity, utilisation, risk label, predicted delay and queue."""
    out = runway_load_index(
        df, time_col, window_min, weather_factor, ops_per_window_capacity, occ_per_flight_min, by
    )
    cap = scoring.effective_capacity(F.lit(float(ops_per_window_capacity)), F.lit(float(weather_factor)), window_min)
    n = F.col("movements")
    out = out.withColumns(
        {
            "theoretical_capacity": cap,
            "capacity_utilization_pct": scoring.present(F.try_divide(n, cap) * 100, 1),
        }
    )
    if not include_predictions:
        return out
    return out.withColumns(
        {
            "bottleneck_risk": scoring.risk_label(F.col("rli")),
            "predicted_delay": scoring.present(scoring.predicted_delay(F.col("rli"), window_min), 1),
            "estimated_queue_length": F.rint(F.greatest(n - cap, F.lit(0.0))),
        }
    )


def resample_load(rli: DataFrame, window_min: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Load index on wider windows: movements summed, index averaged."""
    return rli.groupBy(*by, slot_start("slot_start", window_min).alias("slot_start")).agg(
        F.sum("movements").alias("movements"), F.avg("rli").alias("rli")
    )


def load_heatmap(rli: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest and mean load index per (date, hour)."""
    return rli.groupBy(
        *by, F.to_date("slot_start").alias("date"), F.hour("slot_start").cast("bigint").alias("hour")
    ).agg(F.max("rli").alias("max_rli"), F.avg("rli").alias("avg_rli"))


def load_heatmap_wide(rli: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per date with columns ``h00`` .. ``h23`` holding the highest load index."""
    cells = rli.withColumns({"date": F.to_date("slot_start"), "hour": F.format_string("h%02d", F.hour("slot_start"))})
    return cells.groupBy(*by, "date").pivot("hour", [f"h{h:02d}" for h in range(24)]).agg(F.max("rli"))


# ---- best time to operate -----------------------------------------------------------


def best_time_to_operate_enhanced(
    df: DataFrame,
    at_airport: str | None = None,
    kind: str = "arrival",
    window_min: int = 30,
    confidence_level: float = 0.95,
    by: Sequence[str] = (),
) -> DataFrame:
    """Windows by mean delay with t interval and a 0-100 reliability score.

    Empty windows between the first and the last are kept with n = 0. When known
    delays are too few (fewer than 5 or 10 % of the rows) unknown ones count as 0.
    """
    time_col, delay = ("sched_arr", "arr_delay_min") if kind == "arrival" else ("sched_dep", "dep_delay_min")
    scoped = scope_airport(df, at_airport, "arrival" if kind == "arrival" else "departure")
    counted = (
        scoped.filter(F.col(time_col).isNotNull())
        .groupBy(*by, slot_start(time_col, window_min).alias("slot_start"), F.col(delay).alias("delay"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    known, rows = F.sum(F.when(F.col("delay").isNotNull(), F.col("rows")).otherwise(0)), F.sum("rows")
    counted = with_group_stats(counted, by, {"__sparse": known < F.greatest(F.lit(5.0), rows * 0.1)})
    counted = counted.withColumn(
        "delay", F.when(F.col("__sparse"), F.coalesce(F.col("delay"), F.lit(0.0))).otherwise(F.col("delay"))
    )
    slots = value_stats(counted, [*by, "slot_start"], "delay", "rows", rows=scoped.count())
    slots = gap_fill(slots, by, "slot_start", window_min, zeros=["n"], nulls=["mean", "std", "median"])

    n, mean, std = F.col("n"), F.col("mean"), F.col("std")
    margin = F.coalesce(t_critical(n - 1, confidence_level) * std / F.sqrt(n), F.lit(0.0))
    spread = std / F.greatest(mean, F.lit(0.1))
    # one row per window: a group here is bounded by the calendar
    widest = F.max("n").over(Window.partitionBy(*by))
    sample = F.try_divide(F.ln(F.nullif(n, F.lit(0))), F.ln(F.nullif(widest, F.lit(0))))
    score = F.when(n >= 2, (F.lit(0.6) / (1 + spread) + 0.4 * sample) * 100)
    return slots.select(
        *by,
        "slot_start",
        scoring.present(mean, 2).alias("mean_delay_min"),
        scoring.present(mean - margin, 2).alias("ci_lower"),
        scoring.present(mean + margin, 2).alias("ci_upper"),
        scoring.present(score, 1).alias("reliability_score"),
        "n",
        F.col("median").alias("median_delay_min"),
    ).orderBy(F.asc_nulls_last("mean_delay_min"), *by, "slot_start")


def best_time_to_operate(
    df: DataFrame,
    at_airport: str | None = None,
    kind: str = "arrival",
    window_min: int = 30,
    by: Sequence[str] = (),
) -> DataFrame:
    return best_time_to_operate_enhanced(df, at_airport, kind, window_min, by=by).select(
        *by, "slot_start", "mean_delay_min", "n"
    )


# ---- hourly consolidation -----------------------------------------------------------


# The names of the metrics, in the order of their answer.
CONSOLIDATION_METRICS = ["total_departures", "max_in_any_hour", "share_top_2h_block_%", "share_top_3h_block_%"]


def consolidation(df: DataFrame, time_col: str = "sched_dep", by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, value): total, fullest hour, share of the fullest 2 h and 3 h blocks.

    A block needs all its hours inside the covered period, else its share is NULL.
    """
    hours = dense_slots(df, time_col, require_window(60), by)
    along = Window.partitionBy(*by).orderBy("slot_start")  # hourly rows, bounded by the calendar

    def block(width: int) -> Column:
        frame = along.rowsBetween(1 - width, 0)
        return F.when(F.count(F.lit(1)).over(frame) == width, F.sum("movements").over(frame))

    rolled = hours.withColumns({"__two": block(2), "__three": block(3)})
    total = F.sum("movements")
    share = lambda c: scoring.present(F.max(c) * 100.0 / F.nullif(total, F.lit(0)), 1)
    values = [total.cast("double"), F.max("movements").cast("double"), share("__two"), share("__three")]
    wide = rolled.groupBy(*by).agg(*[v.alias(name) for v, name in zip(values, CONSOLIDATION_METRICS)])
    wide = wide.filter(F.col(CONSOLIDATION_METRICS[0]).isNotNull())
    return wide.unpivot([F.col(c) for c in by], CONSOLIDATION_METRICS, "metric", "value")

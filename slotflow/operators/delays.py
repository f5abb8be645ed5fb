"""Delay fallbacks, delay propagation and delay estimates of shifted schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotflow.functions.ordered import band_sums, lowest_in_group
from slotflow.functions.times import HOUR, micros, slot_start
from slotflow.operators.scope import in_groups, join_null_safe, with_group_stats
from slotflow.operators.slots import slot_counts

LATE_MIN = 5  # a movement counts as delayed above this


def too_few(delay: str) -> Column:
    """Aggregate: fewer known delays than 5 or than 10 % of the rows."""
    return F.count(delay) < F.greatest(F.lit(5.0), F.count(F.lit(1)) * 0.1)


def _flag_sparse(df: DataFrame, delay: str, by: Sequence[str], out: str) -> tuple[DataFrame, bool]:
    """Add the flag; also tells whether it can be true at all.

    Without groups the answer is one value, asked up front: the usual case of enough
    delays then needs no fallback plan.
    """
    if by:
        return with_group_stats(df, by, {out: too_few(delay)}), True
    sparse = df.agg(too_few(delay)).first()[0]
    return df.withColumn(out, F.lit(sparse)), sparse


def fill_sparse_delays(df: DataFrame, delay: str, by: Sequence[str] = ()) -> DataFrame:
    """``delay_used``: unknown delays count as 0, but only where known ones are too few."""
    flagged, _ = _flag_sparse(df, delay, by, "__sparse")
    filled = F.when(F.col("__sparse"), F.coalesce(F.col(delay), F.lit(0.0))).otherwise(F.col(delay))
    return flagged.withColumn("delay_used", filled).drop("__sparse")


def ensure_delay_metric(
    df: DataFrame, capacity: Column | int, window_min: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """Replace ``dep_delay_min`` by 3 min per movement over capacity when delays are too few.

    Adds ``used_fallback``. Slot counts are aggregated first and joined back, so a
    crowded slot is never gathered in one task.
    """
    cap = F.lit(capacity) if isinstance(capacity, int) else capacity
    flagged, possible = _flag_sparse(df, "dep_delay_min", by, "used_fallback")
    if not possible:
        return flagged
    over = slot_counts(df, "sched_dep", window_min, by).withColumnsRenamed(
        {"slot_start": "__slot", "movements": "__n"}
    )
    synthetic = F.coalesce(F.greatest(F.col("__n") - cap, F.lit(0)) * 3.0, F.lit(0.0))
    return (
        join_null_safe(
            flagged.withColumn("__slot", slot_start("sched_dep", window_min)), over, [*by, "__slot"], "left"
        )
        .withColumn(
            "dep_delay_min", F.when(F.col("used_fallback"), synthetic).otherwise(F.col("dep_delay_min"))
        )
        .drop("__slot", "__n")
    )


def slot_mean_delay(df: DataFrame, window_min: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, slot_start, mean_delay) with 0 where no delay is known."""
    slot = slot_start("sched_dep", window_min).alias("slot_start")
    return (
        df.filter(F.col("sched_dep").isNotNull())
        .groupBy(*by, slot)
        .agg(F.coalesce(F.avg("dep_delay_min"), F.lit(0.0)).alias("mean_delay"))
    )


def estimate_total_dep_delay(
    df: DataFrame, times: DataFrame, time_col: str = "sched_dep", window_min: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """Expected departure delay of a (shifted) schedule: each movement takes its slot's mean.

    Both sides are reduced to slots before they meet, so the join is slot-sized.
    """
    load = slot_counts(times, time_col, window_min, by)
    cost = F.coalesce(F.col("mean_delay"), F.lit(0.0)) * F.col("movements")
    return (
        join_null_safe(load, slot_mean_delay(df, window_min, by), [*by, "slot_start"], "left")
        .groupBy(*by)
        .agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_dep_delay"))
    )


def delay_propagation_analysis(
    df: DataFrame, time_window_hours: int = 2, by: Sequence[str] = (), limit: int | None = 20
) -> DataFrame:
    """For each late movement: how many movements follow within the window and how late they are.

    The first ``limit`` of each group in time order (all when None). Following movements are summed
    per instant over a sliding band, so cost grows with the rows, not with the pairs.
    """
    delay, rows = F.coalesce(F.col("dep_delay_min"), F.lit(0.0)), df.count()
    timed = in_groups(df, by).filter(F.col("sched_dep").isNotNull()).select(
        *by,
        "row_id",
        "flight_id",
        "sched_dep",
        delay.alias("initial_delay"),
        micros("sched_dep").alias("__t"),
    )
    late = F.when(F.col("initial_delay") > LATE_MIN, 1).otherwise(0)
    following = band_sums(
        timed,
        by,
        "__t",
        1,
        time_window_hours * HOUR,
        {"__n": F.lit(1), "__late": late, "__sum": F.col("initial_delay")},
        rows=rows,
    ).filter(F.col("__n") > 0)
    out = (
        timed.filter(F.col("initial_delay") > LATE_MIN)
        .join(following, [*by, "__t"])
        .select(
            *by,
            "row_id",
            F.col("flight_id").alias("initiating_flight"),
            "initial_delay",
            F.col("sched_dep").alias("time_window_start"),
            F.least(F.col("initial_delay") * 0.1, F.col("__sum") / F.nullif(F.col("__n"), F.lit(0.0))).alias(
                "avg_delay_propagation"
            ),
            F.col("__late").cast("bigint").alias("affected_flights"),
            F.col("__n").cast("bigint").alias("total_future_flights"),
        )
    )
    order = ["time_window_start", "row_id"]
    if limit is None:
        return out
    return lowest_in_group(out, by, order, limit, "__place", rows).drop("__place") if by else out.orderBy(*order).limit(limit)

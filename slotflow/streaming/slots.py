"""Slot counts and load index of a stream of movements.

Same slots and formula as the batch operators. A window is emitted once the watermark
has passed its end; windows without movements are not emitted, because a gap is only
known when a later window arrives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotflow.functions.times import require_window
from slotflow.operators.slots import add_load_index


def stream_slot_counts(
    stream: DataFrame,
    time_col: str = "sched_dep",
    window_min: int = 5,
    by: Sequence[str] = (),
    lateness: str = "10 minutes",
) -> DataFrame:
    """(by, slot_start, movements) per closed window, for append output."""
    # event time must be a zoned timestamp; the session runs in UTC
    timed = stream.filter(F.col(time_col).isNotNull()).withColumn("__event", F.col(time_col).cast("timestamp"))
    counted = (
        timed.withWatermark("__event", lateness)
        .groupBy(*by, F.window("__event", f"{require_window(window_min)} minutes").alias("__w"))
        .agg(F.count(F.lit(1)).alias("movements"))
    )
    return counted.select(*by, F.col("__w.start").cast("timestamp_ntz").alias("slot_start"), "movements")


def stream_load_index(
    stream: DataFrame,
    time_col: str = "sched_dep",
    window_min: int = 5,
    weather_factor: float = 1.0,
    ops_per_window_capacity: int = 12,
    by: Sequence[str] = (),
    lateness: str = "10 minutes",
) -> DataFrame:
    counts = stream_slot_counts(stream, time_col, window_min, by, lateness)
    return add_load_index(
        counts, window_min, F.lit(float(weather_factor)), F.lit(float(ops_per_window_capacity))
    )

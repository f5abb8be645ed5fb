"""Capacity, risk and priority formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotflow.functions.times import minutes_between

# Fixed values of the scoring model.
HARD_TO_MOVE_CARRIERS = ["AI", "9W", "6E"]
PEAK_HOURS = [6, 7, 8, 9, 18, 19, 20, 21]
RELIEF_HOURS = [7, 8, 19, 20]
RISK_STEPS = [(0.7, "Low"), (0.9, "Medium"), (1.1, "High")]


def present(value: Column, digits: int) -> Column:
    """Round for display; the inner step keeps last-bit noise from deciding a tie."""
    return F.round(F.round(value, 9), digits)


def effective_capacity(capacity: Column, weather: Column, window_min: int) -> Column:
    """Movements a window can take: capacity is stated per five minutes."""
    return capacity * F.greatest(weather, F.lit(1e-3)) * F.lit(window_min / 5.0)


def load_index(movements: Column, capacity: Column, occupancy_min: float) -> Column:
    return F.try_divide(movements * F.lit(occupancy_min), capacity)


def risk_label(load: Column) -> Column:
    """Right-closed bands; an idle slot has no label."""
    label = F.when(load <= 0, F.lit(None))
    for top, name in RISK_STEPS:
        label = label.when(load <= top, name)
    return label.when(load > RISK_STEPS[-1][0], "Critical")


def predicted_delay(load: Column, window_min: int) -> Column:
    return F.when(load <= 1.0, F.lit(0.0)).otherwise((load - 1.0) * F.lit(10.0 * window_min))


def is_peak_hour(ts: Column) -> Column:
    return F.hour(ts).isin(PEAK_HOURS)


def move_priority(delay: Column, carrier: Column, sched: Column, tail: Column) -> Column:
    """Reluctance to move a flight: the lowest score moves first."""
    size = F.abs(F.coalesce(delay, F.lit(0.0)))
    airline = F.when(F.upper(carrier).isin(HARD_TO_MOVE_CARRIERS), 2.0).otherwise(1.0)
    peak = F.when(is_peak_hour(sched), 1.5).otherwise(1.0)
    turn = F.when(F.trim(tail) != "", 1.2).otherwise(1.0)
    return size * airline * peak * turn


def rotation_weight(arrives: Column, departs: Column) -> Column:
    """Strength of an aircraft rotation by its turn time."""
    turn = minutes_between(departs, arrives)
    return F.when(turn.isNull(), 0.3).when(turn < 45, 0.9).when(turn < 90, 0.7).otherwise(0.4)


def relief_score(old_time: Column) -> Column:
    return F.when(F.hour(old_time).isin(RELIEF_HOURS), 2.0).otherwise(1.0)

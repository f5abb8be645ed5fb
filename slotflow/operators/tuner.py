"""Greedy slot tuning as a parallel job over independent time islands.

The cost of a move depends only on the slots involved, and a full slot is never a
target. So an overloaded slot simply fills its open neighbours in cost order, and
overloaded slots that cannot reach a common open slot do not affect each other. The
sequential part therefore runs on slot rows, whole islands per task group; the
movements themselves are only ranked and joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotflow.functions.ordered import lowest_in_group
from slotflow.functions.scoring import PEAK_HOURS, move_priority, relief_score
from slotflow.functions.times import MINUTE, add_minutes, floor_div, from_micros, micros, slot_start
from slotflow.operators.scope import in_groups, schedule_time, scope_airport, with_group_stats
from slotflow.operators.slots import slot_counts
from slotflow.session import cut_lineage

# Fixed values of the move cost and of the multi-objective score.
TARGET_COST, PEAK_COST = 0.3, 1.5
OBJECTIVES = {
    "minimize_peak_congestion": 0.4,
    "minimize_passenger_disruption": 0.4,
    "minimize_total_shifts": 0.2,
}
TOP_MOVES = 50

_BATCH = 1000  # overloaded slots per Python call, rounded up to whole islands


def _batches(slots: DataFrame, keys: Sequence[str], window_min: int) -> DataFrame:
    """(keys, batch, pos, cap, max_shift, reach) of the overloaded slots.

    ``pos`` is the slot number on the time axis. Two neighbouring overloaded slots
    are in one island unless they are too far apart for a common target, or every
    slot both could reach is full. Whole islands are packed into batches, so that
    one Python call handles many short islands.
    """
    along = Window.partitionBy(*keys).orderBy("pos")  # slot rows: bounded by the calendar
    run = Window.partitionBy(*keys, "__run")
    full = (
        slots.withColumn("pos", floor_div(micros("slot_start"), window_min * MINUTE))
        .withColumn("reach", floor_div(F.col("max_shift"), window_min))
        .filter((F.col("movements") >= F.col("cap")) & (F.col("reach") > 0))
        .withColumn("__run", F.col("pos") - F.row_number().over(along))
        .withColumns({"__from": F.min("pos").over(run), "__to": F.max("pos").over(run)})
    )
    over = full.filter(F.col("movements") > F.col("cap"))
    before, reach = F.lag("pos").over(along), F.col("reach")
    gap = F.col("pos") - before
    saturated = (gap <= reach) & (F.col("__from") <= F.col("pos") - reach) & (F.col("__to") >= before + reach)
    starts = before.isNull() | (gap > 2 * reach) | saturated
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    island_start = F.max(F.when(F.col("__starts"), F.col("__nth"))).over(upto)
    return (
        over.withColumns({"__starts": starts, "__nth": F.row_number().over(along)})
        .withColumn("batch", floor_div(island_start, _BATCH))
        .select(*keys, "batch", "pos", "cap", "max_shift", "reach")
    )


def _fill_batch(rows: pd.DataFrame, keys: list[str], window_min: int) -> pd.DataFrame:
    """Moves of some islands: each overloaded slot, in time order, fills its cheapest open targets."""
    count = dict(zip(rows["pos"].tolist(), rows["movements"].tolist()))
    cap, max_shift = int(rows["cap"].iat[0]), float(rows["max_shift"].iat[0])
    reach, per_day = int(rows["reach"].iat[0]), 1440 // window_min
    out = []
    for pos in sorted(rows.loc[rows["own"], "pos"].tolist()):
        offers = []
        for step in range(1, reach + 1):
            for shift in (-step, step):
                room = cap - count[pos + shift]
                if room > 0:
                    hour = ((pos + shift) % per_day) * window_min // 60
                    weight = PEAK_COST if hour in PEAK_HOURS else 1.0
                    offers.append((step * window_min / max_shift + TARGET_COST * weight, shift, room))
        offers.sort(key=lambda o: o[0])  # stable: the smaller shift, then the earlier slot, stays first
        left, rank = count[pos] - cap, 1
        for cost, shift, room in offers:
            moved = min(room, left)
            if moved == 0:
                break
            out.append((pos, rank, rank + moved - 1, pos + shift, shift * window_min, cost))
            count[pos + shift] += moved
            count[pos] -= moved
            left, rank = left - moved, rank + moved
    moves = pd.DataFrame(out, columns=["pos", "rank_from", "rank_to", "target", "shift_min", "move_cost"])
    for key in reversed(keys):
        moves.insert(0, key, rows[key].iat[0])
    return moves


def plan_moves(slots: DataFrame, window_min: int, keys: Sequence[str] = ()) -> DataFrame:
    """Moves between slots: (keys, slot_start, rank_from, rank_to, target_slot, shift_min, move_cost).

    ``slots`` has (keys, slot_start, movements, cap, max_shift). Ranks say which of a
    slot's movements, easiest first, take the move. ``keys`` may hold scenario columns.
    """
    keys = list(keys)
    over = _batches(slots, keys, window_min)
    reached = over.select(
        *keys, "batch", "cap", "max_shift", "reach", "pos", F.explode(F.expr("sequence(pos - reach, pos + reach)")).alias("at")
    )
    around = reached.groupBy(*keys, "batch", F.col("at").alias("pos"), "cap", "max_shift", "reach").agg(
        F.bool_or(F.col("at") == F.col("pos")).alias("own")
    )
    counts = slots.select(
        *keys,
        floor_div(micros("slot_start"), window_min * MINUTE).alias("pos"),
        "movements",
    )
    rows = around.join(counts, [*keys, "pos"], "left").withColumn(
        "movements", F.coalesce(F.col("movements"), F.lit(0).cast("bigint"))
    )
    # a group holds some islands' slot rows (calendar-bounded), never movements
    key_types = [f"`{k}` {t}" for k, t in rows.select(*keys).dtypes]
    fields = ["pos bigint", "rank_from bigint", "rank_to bigint", "target bigint", "shift_min bigint", "move_cost double"]
    schema = ", ".join(key_types + fields)
    filled = rows.groupBy(*keys, "batch").applyInPandas(lambda pdf: _fill_batch(pdf, keys, window_min), schema)
    at = lambda c: from_micros(F.col(c) * F.lit(window_min * MINUTE))
    return filled.select(
        *keys, at("pos").alias("slot_start"), "rank_from", "rank_to", at("target").alias("target_slot"), "shift_min", "move_cost"
    )


def slots_after(slots: DataFrame, moves: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Slot counts once the moves are made: (keys, slot_start, movements)."""
    size = F.col("rank_to") - F.col("rank_from") + 1
    change = (
        slots.select(*keys, "slot_start", "movements")
        .unionByName(moves.select(*keys, "slot_start", (-size).alias("movements")))
        .unionByName(moves.select(*keys, F.col("target_slot").alias("slot_start"), size.alias("movements")))
    )
    return change.groupBy(*keys, "slot_start").agg(F.sum("movements").alias("movements"))


def assign_moves(
    df: DataFrame,
    moves: DataFrame,
    window_min: int,
    by: Sequence[str] = (),
    scenario: Sequence[str] = (),
) -> DataFrame:
    """Pick the movements that take the planned moves, easiest to move first.

    Only slots with moves are ranked, and no further than the last rank that moves; a
    crowded slot is ranked in blocks.
    """
    slot = slot_start("sched_dep", window_min)
    priority = move_priority(F.col("dep_delay_min"), F.col("carrier"), F.col("sched_dep"), F.col("tail_number"))
    flights = df.filter(F.col("sched_dep").isNotNull()).select(
        *by, "row_id", "flight_id", "sched_dep", priority.alias("priority_score"), slot.alias("__slot")
    )
    wanted = moves.groupBy(*by, F.col("slot_start").alias("__slot")).agg(F.max("rank_to").alias("__most"))
    ranked = lowest_in_group(
        flights.join(wanted, [*by, "__slot"]), [*by, "__slot"], ["priority_score", "row_id"], F.col("__most"), "slot_rank", df.count()
    )
    chosen = ranked.join(moves.withColumnRenamed("slot_start", "__slot"), [*by, "__slot"]).filter(
        F.col("slot_rank").between(F.col("rank_from"), F.col("rank_to"))
    )
    return chosen.select(
        *scenario,
        *by,
        "row_id",
        "flight_id",
        F.col("sched_dep").alias("old_time"),
        add_minutes("sched_dep", F.col("shift_min")).alias("new_time"),
        "shift_min",
        "priority_score",
        "move_cost",
        F.col("__slot").alias("slot_start"),
        F.col("slot_rank").cast("bigint").alias("slot_rank"),
    )


def demo_capacity(slots: DataFrame, capacity: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``observed_peak``, ``cap`` and ``demo_mode`` to slot counts.

    When the capacity is never exceeded it is lowered to one below the peak, so that
    tuning has something to show.
    """
    out = with_group_stats(slots, by, {"observed_peak": F.max("movements")})
    demo = (F.col("observed_peak") > 0) & (F.lit(capacity) >= F.col("observed_peak"))
    return out.withColumns(
        {
            "cap": F.when(demo, F.greatest(F.lit(1), F.col("observed_peak") - 1)).otherwise(F.lit(capacity)).cast("bigint"),
            "demo_mode": demo,
        }
    )


def greedy_slot_tuner_enhanced(
    df: DataFrame,
    airport: str | None = None,
    window_min: int = 5,
    max_shift_min: int = 15,
    per_window_capacity: int = 12,
    by: Sequence[str] = (),
) -> DataFrame:
    """Suggested shifts that bring overloaded slots down to capacity where neighbours have room."""
    scoped = in_groups(schedule_time(scope_airport(df, airport, "origin_first")), by)
    slots = slot_counts(scoped, "sched_dep", window_min, by).withColumns(
        {"cap": F.lit(per_window_capacity).cast("bigint"), "max_shift": F.lit(max_shift_min).cast("bigint")}
    )
    moves = plan_moves(slots, window_min, by)
    return assign_moves(scoped, cut_lineage(moves), window_min, by)


greedy_slot_tuner = greedy_slot_tuner_enhanced


def score_moves(
    suggestions: DataFrame,
    objectives: Sequence[str] | None = None,
    by: Sequence[str] = (),
    top_n: int = TOP_MOVES,
) -> DataFrame:
    """Rank suggestions by congestion relief, disruption and efficiency; the best ``top_n``."""
    chosen = list(OBJECTIVES) if objectives is None else list(objectives)
    unknown = set(chosen) - OBJECTIVES.keys()
    if unknown:
        raise ValueError(f"unknown objectives {sorted(unknown)}")
    scored = with_group_stats(
        suggestions, by, {"__widest": F.max(F.abs("shift_min")), "__moves": F.count(F.lit(1))}
    ).withColumns(
        {
            "congestion_score": relief_score(F.col("old_time")),
            "disruption_score": 1.0 - F.abs("shift_min") / F.col("__widest"),
            "efficiency_score": F.lit(1.0) / F.col("__moves"),
        }
    )
    parts = {
        "minimize_peak_congestion": F.col("congestion_score"),
        "minimize_passenger_disruption": F.col("disruption_score"),
        "minimize_total_shifts": F.col("efficiency_score"),
    }
    total = F.lit(0.0)
    for name in chosen:
        total = total + F.lit(OBJECTIVES[name]) * parts[name]
    scored = scored.withColumn("composite_score", total).drop("__widest", "__moves")
    order = [F.desc("composite_score"), F.asc("slot_start"), F.asc("slot_rank")]
    if not by:
        return scored.orderBy(*order).limit(top_n)
    best = scored.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return best.filter(F.col("__rank") <= top_n).drop("__rank")


def multi_objective_tuner(
    df: DataFrame,
    airport: str | None = None,
    objectives: Sequence[str] | None = None,
    window_min: int = 5,
    max_shift_min: int = 15,
    per_window_capacity: int = 12,
    by: Sequence[str] = (),
) -> DataFrame:
    moves = greedy_slot_tuner_enhanced(df, airport, window_min, max_shift_min, per_window_capacity, by)
    return score_moves(cut_lineage(moves), objectives, by)  # the scores read the moves twice


# ---- applying suggestions -----------------------------------------------------------


def _last_suggestion(suggestions: DataFrame, key: str) -> DataFrame:
    """(key, new_time, shift_min): a row id moves once; of several moves of an id the last wins."""
    have = suggestions.columns
    new_time = F.col("new_time") if "new_time" in have else F.lit(None).cast("timestamp_ntz")
    shift = F.col("shift_min") if "shift_min" in have else F.lit(None).cast("bigint")
    pick = F.struct(new_time.alias("new_time"), shift.alias("shift_min"))
    known = suggestions.filter(F.col(key).isNotNull())
    if key == "row_id":
        return known.select(key, pick.alias("__move"))
    order = F.struct(*[F.col(c) for c in ("slot_start", "slot_rank") if c in have] or [F.col("row_id")])
    return known.groupBy(key).agg(F.max_by(pick, order).alias("__move"))


def apply_suggestions(df: DataFrame, suggestions: DataFrame, key: str = "row_id") -> DataFrame:
    """Add ``sched_dep_after``: the suggested time, else the old time plus the suggested shift, else unchanged."""
    move = F.col("__move")
    after = F.coalesce(move["new_time"], add_minutes("sched_dep", move["shift_min"]), F.col("sched_dep"))
    return df.join(_last_suggestion(suggestions, key), key, "left").withColumn("sched_dep_after", after).drop("__move")


def build_tuned_schedule(df: DataFrame, suggestions: DataFrame, key: str = "row_id") -> DataFrame:
    """Each movement's departure before and after tuning, as text."""
    show = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))
    return apply_suggestions(df, suggestions, key).select(
        "row_id",
        "flight_id",
        "carrier",
        "flight_number",
        "tail_number",
        "origin",
        "destination",
        "airport",
        show("sched_dep").alias("scheduled_departure_before"),
        show("sched_dep_after").alias("scheduled_departure_after"),
        "dep_delay_min",
        "arr_delay_min",
    )

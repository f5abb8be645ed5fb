"""Dependency edges between movements and delay influence over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType

from slotflow.functions.ordered import band_parts, band_sums, join_null_safe, next_rows, running_number
from slotflow.functions.scoring import rotation_weight
from slotflow.functions.times import HOUR, micros, slot_start
from slotflow.operators.scope import has_any, in_groups, primary_time, scope_airport
from slotflow.session import cut_lineage
from slotflow.sources.tables import number_rows

# Fixed values of the dependency model.
GATE_WEIGHT = 0.35
QUEUE_WEIGHT, QUEUE_DECAY, QUEUE_DEPTH = 0.3, 0.8, 3
CREW_WEIGHT, CREW_FROM_H, CREW_TO_H = 0.4, 2, 6
KIND_RANK = {"rotation": 1, "runway": 2, "gate": 3}  # crew outranks all

EDGE_COLUMNS = ["src", "dst", "kind", "weight"]


def movement_uid(df: DataFrame) -> DataFrame:
    """``uid``: flight id and the number of its occurrence in source order."""
    numbered = running_number(df, ["flight_id"])
    return numbered.withColumn("uid", F.concat_ws("_", "flight_id", "occurrence")).drop("occurrence")


def _crew_linked(carrier_a: Column, time_a: Column, carrier_b: Column, time_b: Column) -> Column:
    gap = micros(time_b) - micros(time_a)
    same = (carrier_a == carrier_b) & gap.between(CREW_FROM_H * HOUR, CREW_TO_H * HOUR)
    return F.coalesce(same, F.lit(False))


def _edges_to_next(rows: DataFrame, kind: str, weight: Column) -> DataFrame:
    """One edge per entry of ``next_rows``; ``pos`` counts from 0, ``nxt`` is the entry."""
    pairs = rows.select("row_id", "carrier", "sched_dep", "sched_arr", F.posexplode("next_rows").alias("pos", "nxt"))
    nxt = F.col("nxt")
    return pairs.select(
        F.col("row_id").alias("src"),
        nxt["row_id"].alias("dst"),
        F.lit(kind).alias("kind"),
        weight.alias("weight"),
        _crew_linked(F.col("carrier"), F.col("sched_dep"), nxt["carrier"], nxt["sched_dep"]).alias("crew_linked"),
    )


def dependency_edges(df: DataFrame, slot_min: int = 5, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Rotation, runway and gate edges: (src, dst, kind, weight, crew_linked).

    At most 1 + 3 + 1 edges leave a movement. Crew links (same carrier, departing two
    to six hours later) are dense and stay implicit: see :func:`crew_links`.
    ``crew_linked`` marks edges whose pair is also a crew link, which replaces them.
    ``rows`` is the number of movements where the caller knows it.
    """
    rows = df.count() if rows is None else rows
    base = in_groups(df, by).select(
        *by, "row_id", "carrier", "tail_number", "gate", "sched_dep", "sched_arr", primary_time().alias("__when")
    )
    take = ["row_id", "carrier", "sched_dep"]
    rotation = next_rows(base.filter(F.col("tail_number").isNotNull()), [*by, "tail_number"], "sched_dep", take, rows=rows)
    gate = next_rows(base.filter(F.col("gate").isNotNull()), [*by, "gate"], "sched_dep", take, rows=rows)
    queued = base.filter(F.col("__when").isNotNull()).withColumn("__slot", slot_start("__when", slot_min))
    runway = next_rows(queued, [*by, "__slot"], "sched_dep", take, QUEUE_DEPTH, rows=rows)
    queue = F.lit(QUEUE_WEIGHT) * F.pow(F.lit(QUEUE_DECAY), F.col("pos").cast("double"))
    return (
        _edges_to_next(rotation, "rotation", rotation_weight(F.col("sched_arr"), F.col("nxt.sched_dep")))
        .unionByName(_edges_to_next(runway, "runway", queue))
        .unionByName(_edges_to_next(gate, "gate", F.lit(GATE_WEIGHT)))
    )


def _kind_rank() -> Column:
    rank = F.lit(0)
    for kind, place in KIND_RANK.items():
        rank = F.when(F.col("kind") == kind, place).otherwise(rank)
    return rank


def effective_edges(edges: DataFrame) -> DataFrame:
    """One weight per pair: the later kind wins, crew links take the pair away."""
    return (
        edges.filter(~F.col("crew_linked"))
        .groupBy("src", "dst")
        .agg(F.max_by("weight", _kind_rank()).alias("weight"), F.max_by("kind", _kind_rank()).alias("kind"))
    )


def _links(edges: DataFrame, incoming: bool) -> DataFrame:
    """(row_id, links): the at most five explicit edges along which a movement passes weight on.

    Pairs linked by several kinds keep the later kind; this is settled inside the
    small array, so one shuffle both groups and deduplicates.
    """
    here, there = ("src", "dst") if incoming else ("dst", "src")
    entry = F.struct(F.col(there).alias("to"), _kind_rank().alias("rank"), "weight")
    beaten = lambda x, all_: F.exists(all_, lambda y: (y["to"] == x["to"]) & (y["rank"] > x["rank"]))
    return (
        edges.filter(~F.col("crew_linked"))
        .groupBy(F.col(here).alias("row_id"))
        .agg(F.collect_list(entry).alias("__e"))
        .select("row_id", F.filter("__e", lambda x: ~beaten(x, F.col("__e"))).alias("links"))
    )


def _crew_band(incoming: bool) -> tuple[int, int]:
    """Where the partners of a movement depart: earlier ones when ``incoming``, else later ones."""
    low, high = CREW_FROM_H * HOUR, CREW_TO_H * HOUR
    return (-high, -low) if incoming else (low, high)


def _crew_weight(incoming: bool) -> Column:
    """Weighted sum over the partners, from their plain sum ``__n`` and the sum of their gaps ``__gap``.

    The weight falls linearly with the gap, 0.4 at two hours to 0 at six, so that the
    partners themselves are never needed.
    """
    slope = CREW_WEIGHT / (CREW_TO_H - CREW_FROM_H)
    return F.lit(CREW_WEIGHT + slope * CREW_FROM_H) * F.col("__n") - F.lit(slope if incoming else -slope) * F.col("__gap")


def crew_links(df: DataFrame, incoming: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Per movement: number of crew partners and their total weight.

    Partners are movements of the same carrier that depart two to six hours earlier
    (``incoming``) or later. A movement without carrier or departure has none.
    """
    points = in_groups(df, by).select(*by, "row_id", "carrier", micros("sched_dep").alias("__t"))
    crewed = points.filter(F.col("carrier").isNotNull())
    sums = band_sums(crewed, [*by, "carrier"], "__t", *_crew_band(incoming), {"__n": F.lit(1)}, {"__gap": "__n"}, HOUR, df.count())
    return points.join(sums, [*by, "carrier", "__t"], "left").select(
        *by,
        "row_id",
        F.coalesce(F.col("__n"), F.lit(0.0)).cast("bigint").alias("links"),
        F.coalesce(_crew_weight(incoming), F.lit(0.0)).alias("weight_sum"),
    )


def _node(row_id: Column, kind: DataType) -> list[Column]:
    """``id`` and ``no_id``: a row id as two columns that are never NULL, which a grouping and a join share."""
    if not isinstance(kind, LongType):  # a struct of columns
        return [row_id.alias("id"), F.lit(False).alias("no_id")]
    return [F.coalesce(row_id, F.lit(0)).cast("bigint").alias("id"), row_id.isNull().alias("no_id")]


def propagate(
    df: DataFrame, steps: int, decay: float, direction: str = "incoming", by: Sequence[str] = ()
) -> DataFrame:
    """(row_id, reach) of movements on any path: sum over k of decay^k times the k-step path weight.

    Each movement carries its few explicit edges, so a step sends weight along them
    without an edge join. Movements of a carrier that depart at one instant have the same crew
    partners: they are one cell, so the sliding sums run over cells. What a movement
    gets is summed by row id, as plain numbers, and only then meets its edges. A step's result is
    written to the checkpoint folder: neither the plan nor a recomputation after a lost executor
    grows with the steps.
    """
    if direction not in ("incoming", "outgoing"):
        raise ValueError(f"direction must be 'incoming' or 'outgoing', not {direction!r}")
    incoming = direction == "incoming"
    # written once: every kind of edge reads it twice (borders of blocks, then rows), the steps once more
    df = cut_lineage(df.select("row_id", *by, "carrier", "tail_number", "gate", "sched_dep", "sched_arr"))
    rows = df.count()
    links = _links(dependency_edges(df, 5, by, rows), incoming)
    cell = [*by, "carrier", "__t"]
    points = df.select("row_id", *by, "carrier", micros("sched_dep").alias("__t"))
    cells = cut_lineage(number_rows(points.filter("carrier IS NOT NULL AND __t IS NOT NULL").select(*cell).distinct(), cell, "cell"))
    instants = cells.count()
    fixed = join_null_safe(points.join(links, "row_id", "left"), cells, cell, "left")
    node = _node(F.col("row_id"), df.schema["row_id"].dataType)
    state = cut_lineage(fixed.select(*node, "cell", "links", F.lit(1.0).alias("s"), F.lit(0.0).alias("reach")))
    factor = decay
    for step in range(steps):
        sent = F.col("e.weight") * F.col("s")
        to = _node(F.col("e.to"), df.schema["row_id"].dataType)
        direct = state.filter(F.col("s") != 0).select("s", F.explode("links").alias("e")).select(*to, sent.alias("s"))
        held = cells.join(state.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("s").alias("s")), "cell")
        crew = band_parts(held, [*by, "carrier"], "__t", *_crew_band(incoming), {"__n": F.col("s")}, {"__gap": "__n"}, HOUR, ["cell"], instants)
        weight = crew.select("cell", _crew_weight(incoming).alias("s")).filter("s != 0").groupBy("cell").agg(F.sum("s").alias("s"))
        gained = direct.unionByName(state.select("id", "no_id", "cell").join(weight, "cell").drop("cell"))
        got = gained.groupBy("id", "no_id").agg(F.sum("s").alias("got"))
        s = F.coalesce("got", F.lit(0.0))
        kept = state.drop("s").join(got, ["id", "no_id"], "left")
        if step == 0:  # rows of one row id are one movement from here on; they start with the same reach
            kept = kept.dropDuplicates(["id", "no_id"])
        state = cut_lineage(kept.select("id", "no_id", "cell", "links", s.alias("s"), (F.col("reach") + s * F.lit(factor)).alias("reach")))
        factor *= decay
    return state.select(F.when(~F.col("no_id"), F.col("id")).alias("row_id"), "reach")


def _base_delay(df: DataFrame, base_delay_col: str) -> Column:
    """The chosen delay, or the departure delay where the chosen one holds nothing."""
    usable = base_delay_col in df.columns and has_any(df, F.col(base_delay_col).isNotNull())
    chosen = F.col(base_delay_col if usable else "dep_delay_min")
    return F.greatest(F.coalesce(chosen.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def movement_influence(
    df: DataFrame,
    base_delay_col: str = "arr_delay_min",
    steps: int = 4,
    airport: str | None = None,
    decay_factor: float = 0.85,
    direction: str = "incoming",
    by: Sequence[str] = (),
) -> DataFrame:
    """Influence per movement (row), before the roll-up by flight id."""
    scoped = in_groups(scope_airport(df, airport, "any"), by)
    reach = propagate(scoped, steps, decay_factor, direction, by)
    b, r = F.col("direct_impact"), F.coalesce(F.col("reach"), F.lit(0.0))
    return (
        scoped.select(*by, "row_id", "flight_id", _base_delay(scoped, base_delay_col).alias("direct_impact"))
        .join(reach, "row_id", "left")
        .select(
            *by,
            "row_id",
            "flight_id",
            (b * (1 + r)).alias("influence_delta_total_delay"),
            "direct_impact",
            (b * r).alias("cascading_impact"),
            (b * r / F.greatest(b, F.lit(0.1))).alias("influence_ratio"),
        )
    )


def influence_table_enhanced(
    df: DataFrame,
    base_delay_col: str = "arr_delay_min",
    steps: int = 4,
    airport: str | None = None,
    decay_factor: float = 0.85,
    direction: str = "incoming",
    by: Sequence[str] = (),
) -> DataFrame:
    """Influence per flight id, highest total first.

    ``direction="incoming"`` weighs a movement by the paths that lead to it;
    ``"outgoing"`` by the paths that start at it.
    """
    rows = movement_influence(df, base_delay_col, steps, airport, decay_factor, direction, by)
    return (
        rows.groupBy(*by, "flight_id")
        .agg(
            F.sum("influence_delta_total_delay").alias("influence_delta_total_delay"),
            F.sum("direct_impact").alias("direct_impact"),
            F.sum("cascading_impact").alias("cascading_impact"),
            F.avg("influence_ratio").alias("influence_ratio"),
        )
        .orderBy(F.desc("influence_delta_total_delay"), *by, "flight_id")
    )


def influence_table(
    df: DataFrame,
    base_delay_col: str = "arr_delay_min",
    steps: int = 3,
    airport: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    return influence_table_enhanced(df, base_delay_col, steps, airport, by=by)

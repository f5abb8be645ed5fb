"""Order-dependent building blocks that never put an unbounded key in one task.

A plain window over a key puts all rows of that key in one task, which fails once
one tail, gate, carrier, slot or source file holds a large part of the data. Two ways
keep every window group small, whatever the keys:

- blocks: the rows in their whole order (keys first) are cut by ranges into blocks of
  a bounded number of rows, so that a hot key spans many blocks. Windows run inside
  (key, block); what crosses a block's border is worked out on the few rows at the ends
  of blocks, by the same function. The number of rows decides the number of blocks,
  and one block is the plain window.
- a tree of carries, where row ids already give the order: chunks of row ids, and runs of
  2**12 chunks, pass their last value or their count on.

The result is exactly that of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotflow.functions.times import MINUTE, floor_div, from_micros, micros
from slotflow.session import cut_lineage

BLOCK_ROWS = 1 << 20  # rows of a block, on average
ROW_BIN_BITS = 20  # row ids of a chunk
TREE_BITS = 12  # chunks of a run
_BLOCK = "__block"


def row_bin(row_id: Column | str = "row_id", bits: int = ROW_BIN_BITS) -> Column:
    return F.shiftright(row_id, bits)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys meet each other, so that rows without a key are kept."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(other, match, how).drop(*[f"__r_{k}" for k in keys])


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> tuple[DataFrame, int]:
    """The rows with the number of their block, and how many blocks there are.

    Blocks are ranges of (keys, order), which should tell all rows apart. ``rows`` is the
    number of rows, or a bound of it, where the caller knows one; else they are counted. Where
    one block is not enough the rows are written to the checkpoint folder, so that the borders stay.
    """
    blocks = -(-(df.count() if rows is None else rows) // BLOCK_ROWS)
    if blocks <= 1:
        return df.withColumn(_BLOCK, F.lit(0)), 1
    # twice as many as the average asks for: ranges come from samples
    ranged = df.repartitionByRange(2 * blocks, *[F.col(c) for c in (*keys, *order)])
    return cut_lineage(ranged.withColumn(_BLOCK, F.spark_partition_id())), 2 * blocks


def _across(blocked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows of keys that may go on in another block: the first and the last key of a block."""
    if not keys:
        return blocked
    key = F.struct(*keys)
    ends = blocked.groupBy(_BLOCK).agg(F.min(key).alias("__a"), F.max(key).alias("__b"))
    held = ends.select(F.explode(F.array("__a", "__b")).alias("__k")).select("__k.*").distinct()
    return join_null_safe(blocked, held, keys, "left_semi")


def next_rows(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    take: Sequence[str],
    n: int = 1,
    out: str = "next_rows",
    rows: int | None = None,
) -> DataFrame:
    """Add ``out``: the up to ``n`` rows that follow within ``keys``, nearest first.

    Order is (time with NULL last, row_id). ``rows``: see :func:`in_blocks`.
    """
    late = df.withColumn("__late", F.col(time).isNull())
    order = ["__late", time, "row_id"]
    blocked, blocks = in_blocks(late, keys, order, rows)
    along = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    payload = F.struct(*take)
    found = blocked.withColumn(out, F.array_compact(F.array(*[F.lead(payload, i).over(along) for i in range(1, n + 1)])))
    if blocks == 1:
        return found.drop(_BLOCK, "__late")
    # The first n rows of every block are all that earlier blocks of the key can reach.
    heads = (
        _across(blocked, keys)
        .withColumn("__nth", F.row_number().over(along))
        .filter(F.col("__nth") <= n)
        .select(*keys, time, "row_id", F.col(_BLOCK).alias("__home"), "__nth", payload.alias("__row"))
    )
    after = (
        next_rows(heads, keys, time, ["__row"], n, "__heads")
        .groupBy(*keys, F.col("__home").alias(_BLOCK))
        .agg(F.transform(F.max_by("__heads", "__nth"), lambda x: x["__row"]).alias("__after"))
    )
    tail = F.coalesce("__after", F.slice(out, 1, 0))
    joined = join_null_safe(found, after, [*keys, _BLOCK], "left")
    return joined.withColumn(out, F.slice(F.concat(out, tail), 1, n)).drop("__after", _BLOCK, "__late")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    up: Mapping[str, Column] | None = None,
    down: Mapping[str, Column] | None = None,
    strict: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Add sums over the rows of the key up to each row (``up``) and from it on (``down``).

    ``order`` tells the rows of a key apart. ``strict`` leaves the row itself out. ``rows``:
    see :func:`in_blocks`. A sum over no rows is NULL.
    """
    up, down = dict(up or {}), dict(down or {})
    blocked, blocks = in_blocks(df, keys, order, rows)
    here = Window.partitionBy(*keys, _BLOCK)
    frame = (Window.unboundedPreceding, -1 if strict else 0)
    first = here.orderBy(*order).rowsBetween(*frame)
    last = here.orderBy(*[F.desc(c) for c in order]).rowsBetween(*frame)
    sums = {n: F.sum(c).over(first) for n, c in up.items()} | {n: F.sum(c).over(last) for n, c in down.items()}
    summed = blocked.withColumns(sums)
    if blocks == 1:
        return summed.drop(_BLOCK)
    whole = _across(blocked, keys).groupBy(*keys, F.col(_BLOCK).alias("__home")).agg(*[F.sum(c).alias(n) for n, c in (up | down).items()])
    other = {f"__o_{n}": F.col(n) for n in up}, {f"__o_{n}": F.col(n) for n in down}
    offsets = running(whole, keys, ["__home"], *other, strict=True).select(*keys, F.col("__home").alias(_BLOCK), *other[0], *other[1])
    joined = join_null_safe(summed, offsets, [*keys, _BLOCK], "left")

    def total(name: str) -> Column:
        inside, outside = F.col(name), F.col(f"__o_{name}")
        return F.when(inside.isNull(), outside).when(outside.isNull(), inside).otherwise(inside + outside)

    return joined.withColumns({n: total(n) for n in (*up, *down)}).drop(*other[0], *other[1], _BLOCK)


def lowest_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: Column | int, out: str, rows: int | None = None) -> DataFrame:
    """The ``limit`` lowest rows of each group with their rank ``out``; ``limit`` may be a column of the group."""
    blocked, blocks = in_blocks(df, keys, order, rows)
    here = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    ranked = blocked.withColumn(out, F.row_number().over(here)).filter(F.col(out) <= limit)
    if blocks == 1:
        return ranked.drop(_BLOCK)
    sizes = _across(blocked, keys).groupBy(*keys, F.col(_BLOCK).alias("__home")).agg(F.count(F.lit(1)).alias("__n"))
    before = running(sizes, keys, ["__home"], {"__before": F.col("__n")}, strict=True).select(*keys, F.col("__home").alias(_BLOCK), "__before")
    place = F.col(out) + F.coalesce("__before", F.lit(0))
    return join_null_safe(ranked, before, [*keys, _BLOCK], "left").withColumn(out, place).filter(F.col(out) <= limit).drop("__before", _BLOCK)


def fill_forward(
    df: DataFrame, keys: Sequence[str], col: str, chunk: str, order: str, out: str, then_back: bool = False
) -> DataFrame:
    """Carry the last non-null ``col`` forward along ``order`` within ``keys``.

    ``chunk`` cuts a key's rows into consecutive runs (monotone in ``order``).
    ``then_back`` fills leading rows from the first non-null value of the key.
    """
    until = Window.unboundedPreceding, -1
    known = lambda place, value: F.when(F.col(value).isNotNull(), F.col(place))
    # One key of all: its NULL parts are equal, and the join and the window share its shuffle.
    whole = F.struct(*keys, F.col(chunk).alias("__chunk_no"))
    per_chunk = (
        df.groupBy(*keys, chunk)
        .agg(F.max_by(col, known(order, col)).alias("__last"), F.min_by(col, known(order, col)).alias("__first"))
        .withColumn("__run", F.shiftright(chunk, TREE_BITS))
    )
    per_run = per_chunk.groupBy(*keys, "__run").agg(
        F.max_by("__last", known(chunk, "__last")).alias("__run_last"), F.min_by("__first", known(chunk, "__first")).alias("__run_first")
    )
    earlier_runs = F.last("__run_last", True).over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(*until))
    carried = per_run.select(*keys, "__run", earlier_runs.alias("__before"), "__run_first")
    if then_back:
        lead = per_run.groupBy(*keys).agg(F.min_by("__run_first", known("__run", "__run_first")).alias("__lead"))
        carried = join_null_safe(carried, lead, keys, "left")
    in_run = F.last("__last", True).over(Window.partitionBy(*keys, "__run").orderBy(chunk).rowsBetween(*until))
    each = join_null_safe(per_chunk.withColumn("__in_run", in_run), carried, [*keys, "__run"], "left").select(
        whole.alias("__key"), F.coalesce("__in_run", "__before").alias("__carry"), *(["__lead"] if then_back else [])
    )
    in_chunk = Window.partitionBy("__key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sources = [F.last(col, True).over(in_chunk), F.col("__carry")] + ([F.col("__lead")] if then_back else [])
    return df.withColumn("__key", whole).join(each, "__key", "left").withColumn(out, F.coalesce(*sources)).drop("__key", "__carry", "__lead")


def running_number(
    df: DataFrame, keys: Sequence[str], order: str = "row_id", out: str = "occurrence", bits: int = ROW_BIN_BITS
) -> DataFrame:
    """0-based number of each row within ``keys`` along ``order`` (a row id); NULL is a key like any other."""
    chunk, run = row_bin(order, bits), F.shiftright("__rb", TREE_BITS)
    binned = df.withColumn("__rb", chunk)
    until = Window.unboundedPreceding, -1
    sizes = binned.groupBy(*keys, "__rb").agg(F.count(F.lit(1)).alias("__n")).withColumn("__run", run)
    runs = sizes.groupBy(*keys, "__run").agg(F.sum("__n").alias("__n"))
    before = runs.select(*keys, "__run", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(*until)).alias("__before"))
    in_run = F.sum("__n").over(Window.partitionBy(*keys, "__run").orderBy("__rb").rowsBetween(*until))
    nothing = F.lit(0).cast("bigint")
    whole = F.struct(*keys, "__rb")  # one key, as in fill_forward
    offsets = join_null_safe(sizes.withColumn("__in_run", in_run), before, [*keys, "__run"]).select(
        whole.alias("__key"), (F.coalesce("__in_run", nothing) + F.coalesce("__before", nothing)).alias("__offset")
    )
    in_bin = Window.partitionBy("__key").orderBy(order)
    return (
        binned.withColumn("__key", whole)
        .join(offsets, "__key")
        .withColumn(out, (F.row_number().over(in_bin) - 1 + F.col("__offset")).cast("bigint"))
        .drop("__key", "__rb", "__offset")
    )


def gap_fill(
    slots: DataFrame,
    by: Sequence[str],
    slot: str,
    minutes: int,
    zeros: Sequence[str] = (),
    nulls: Sequence[str] = (),
) -> DataFrame:
    """Make slot rows contiguous per ``by``: inserted rows get 0 in ``zeros``, NULL in ``nulls``.

    Input is one row per (by, slot), so a group is bounded by the calendar, not by
    the data. A gap is expanded in two steps, which keeps every generated array
    small even when one stray date lies centuries away.
    """
    step, block = minutes * MINUTE, 4096
    ahead = Window.partitionBy(*by).orderBy(slot)
    width = F.coalesce(floor_div(F.lead(micros(slot)).over(ahead) - micros(slot), step), F.lit(1).cast("bigint"))
    first = F.col("__i") == 0
    return (
        slots.withColumn("__n", width)
        .withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__n - 1) div {block}"))))
        .withColumn(
            "__i",
            F.explode(F.expr(f"sequence(__b * {block}, least(__n - 1, __b * {block} + {block - 1}))")),
        )
        .select(
            *by,
            from_micros(micros(slot) + F.col("__i") * F.lit(step)).alias(slot),
            *[F.when(first, F.col(c)).otherwise(F.lit(0)).alias(c) for c in zeros],
            *[F.when(first, F.col(c)).alias(c) for c in nulls],
        )
    )


def value_stats(counted: DataFrame, keys: Sequence[str], value: str, weight: str, rows: int | None = None) -> DataFrame:
    """mean, sample std, n and exact median per key from (key, value, weight) rows.

    Rows with a NULL value only keep their key alive (n = 0). The median is read off running
    counts over the distinct values, in blocks: a key with any number of them never meets in one task.
    """
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(F.lit(0))
    spread = running(counted.select(*keys, v.alias("__v"), w.alias("__w")), keys, ["__v"], {"__c": F.col("__w")}, rows=rows)
    whole = spread.groupBy(*keys).agg(F.sum("__w").alias("__n"), F.sum(F.col("__v") * F.col("__w")).alias("__s"))
    whole = whole.withColumn("__mean", F.try_divide(F.col("__s"), F.col("__n")))
    met = join_null_safe(spread, whole, keys)
    far = F.col("__v") - F.col("__mean")
    # the value at 1-based position p is the one whose running count first reaches p
    at = lambda p: F.when((F.col("__c") - F.col("__w") < p) & (F.col("__c") >= p), F.col("__v"))
    low, high = F.expr("(__n + 1) div 2"), F.expr("__n div 2 + 1")
    return (
        met.groupBy(*keys)
        .agg(
            F.max("__mean").alias("mean"),
            F.max("__n").cast("bigint").alias("n"),
            F.sum(F.col("__w") * far * far).alias("__ss"),
            F.max(at(low)).alias("__lo"),
            F.max(at(high)).alias("__hi"),
        )
        .select(
            *keys,
            "mean",
            F.when(F.col("n") > 1, F.sqrt(F.col("__ss") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("std"),
            "n",
            ((F.col("__lo") + F.col("__hi")) / 2).alias("median"),
        )
    )


def band_parts(
    points: DataFrame,
    by: Sequence[str],
    at: str,
    low: int,
    high: int,
    values: Mapping[str, Column],
    distances: Mapping[str, str] | None = None,
    unit: int = 1,
    keep: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Sums over the time band [at + low, at + high] of each point's ``by``, in one or two parts that add up.

    Linear, and without pairs: the axis is cut in bins as wide as the band, so a band is
    the end of one bin plus the start of the next, and both parts are running sums. Rows are
    (keep, values, distances); (by, at, keep) should tell the points apart. ``distances``
    maps a new name to a value name v and adds the sum of v * (at - t), in ``unit`` micros.
    Offsets are taken from the bin start, which keeps the arithmetic exact where epoch-sized
    products would lose digits. ``rows`` bounds the number of points: see :func:`in_blocks`.
    """
    width = high - low + 1
    names, moments = list(values), dict(distances or {})
    bin_of = lambda t: floor_div(t, width)
    t = F.col(at)
    blank = [F.lit(None).cast("double")] * len(names)
    first, last = t + F.lit(low), t + F.lit(high)
    # At one place a band's first mark stands before the points and its last mark behind them.
    marks = F.stack(
        F.lit(3),
        *[F.lit(1), bin_of(t), t, *[c.cast("double") for c in values.values()]],
        *[F.lit(0), bin_of(first), first, *blank],
        *[F.lit(2), bin_of(last), last, *blank],
    )
    named = list(dict.fromkeys([*by, at, *keep]))
    swept = points.filter(t.isNotNull()).select(*named, marks.alias("__kind", "__bin", "__pos", *names)).filter(
        # an aligned band is one whole bin: its first mark already covers it
        (F.col("__kind") < 2) | (F.col("__bin") != bin_of(first))
    )
    offset = lambda c: (F.col(c) - F.col("__bin") * F.lit(width)) / F.lit(float(unit))
    summed = {n: F.col(n) for n in names} | {f"__m_{n}": offset("__pos") * F.col(n) for n in set(moments.values())}
    told = ["__pos", "__kind", *[c for c in named if c not in by and c != at], at]
    lanes = running(
        swept, [*by, "__bin"], told, {f"__u_{n}": c for n, c in summed.items()}, {f"__d_{n}": c for n, c in summed.items()},
        rows=None if rows is None else 3 * rows,
    ).filter(F.col("__kind") != 1)
    part = lambda n: F.when(F.col("__kind") == 0, F.col(f"__d_{n}")).otherwise(F.col(f"__u_{n}"))
    return lanes.select(
        *named, *[part(n).alias(n) for n in names], *[(offset(at) * part(n) - part(f"__m_{n}")).alias(m) for m, n in moments.items()]
    )


def band_sums(
    df: DataFrame,
    by: Sequence[str],
    at: str,
    low: int,
    high: int,
    values: Mapping[str, Column],
    distances: Mapping[str, str] | None = None,
    unit: int = 1,
    rows: int | None = None,
) -> DataFrame:
    """One row per (by, at) with the sums of :func:`band_parts` (0 when the band is empty).

    Equal to a range self-join or a sliding RANGE frame: rows are first collapsed to one per instant.
    """
    names, moments = list(values), dict(distances or {})
    cells = df.filter(F.col(at).isNotNull()).groupBy(*by, at).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    parts = band_parts(cells, by, at, low, high, {n: F.col(n) for n in names}, moments, unit, rows=rows)
    return parts.groupBy(*by, at).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in [*names, *moments]])

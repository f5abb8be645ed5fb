"""Airport, date and time scoping of a movement table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotflow.functions.ordered import join_null_safe
from slotflow.functions.times import add_minutes, clock_on
from slotflow.schema import SITE_COLUMNS

TIME_COLUMNS = ("sched_dep", "act_dep", "sched_arr", "act_arr")


def in_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Only rows that have all group keys: a movement without an airport is in no airport's schedule."""
    return df.dropna(subset=list(by)) if by else df


def with_group_stats(df: DataFrame, by: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Append aggregates of each ``by`` group (of the whole frame when empty) to its rows.

    The whole-frame form is a scalar subquery; the grouped form an equi join with one
    row per group, which adaptive execution broadcasts if its size allows, and whose skewed
    groups it splits. Either way the statistics come from one partial aggregation.
    """
    named = [c.alias(n) for n, c in stats.items()]
    if not by:
        one = df.agg(F.struct(*named).alias("s")).scalar()
        return df.withColumn("__s", one).select("*", *[F.col(f"__s.{n}").alias(n) for n in stats]).drop("__s")
    groups = df.groupBy(*by).agg(*named)
    return join_null_safe(df, groups, by)


def presence(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, bool]:
    """Which columns (all by default) hold any value: one aggregate over the frame, one row back."""
    return df.agg(*[(F.count(F.col(c)) > 0).alias(c) for c in columns or df.columns]).first().asDict()


def has_any(df: DataFrame, condition: Column) -> bool:
    """Does any row satisfy the condition? The scan stops at the first one found.

    Asked up front, the answer keeps the plan free of unused fallback columns.
    """
    return not df.filter(condition).isEmpty()


def _names(airport: str, column: str) -> Column:
    return F.coalesce(F.contains(F.upper(F.col(column)), F.lit(airport.upper())), F.lit(False))


def scope_airport(df: DataFrame, airport: str | None, mode: str = "any", on_empty: str = "none") -> DataFrame:
    """Rows of one airport (case-blind literal substring; no airport keeps all rows).

    ``mode``: ``any`` looks at every site column; ``arrival`` at the destination and
    ``departure`` at the origin, each falling back to ``airport`` when that column
    holds nothing; ``origin_first`` uses the first of origin, airport that matches at
    all and keeps every row when neither does. ``on_empty="all"`` keeps every row
    when nothing matches.
    """
    if not airport:
        return df

    home = _names(airport, "airport")
    if mode in ("arrival", "departure"):
        column = "destination" if mode == "arrival" else "origin"
        held = presence(df, [column, "airport"])
        if held[column]:
            keep = _names(airport, column)
        elif held["airport"]:
            keep = home
        else:
            return df
    elif mode == "origin_first":
        origin = _names(airport, "origin")
        keep = next((c for c in (origin, home) if has_any(df, c)), None)
        return df if keep is None else df.filter(keep)
    elif mode == "any":
        keep = reduce(or_, [_names(airport, column) for column in SITE_COLUMNS])
    else:
        raise ValueError(f"unknown scope mode {mode!r}")
    if on_empty == "all":
        return df.filter(keep) if has_any(df, keep) else df
    if on_empty != "none":
        raise ValueError(f"on_empty must be 'none' or 'all', not {on_empty!r}")
    return df.filter(keep)


def scope_conditions(df: DataFrame, airports: Sequence[str]) -> dict[str, dict[str, Column]]:
    """For each airport the conditions of its scopes, from one aggregate over the frame.

    ``view``: rows that name it, every row when none does; ``arrival``, ``departure`` and
    ``origin_first``: those scopes of :func:`scope_airport` within the view; ``any``: only
    rows that name it.
    """
    anywhere = {a: reduce(or_, [_names(a, c) for c in SITE_COLUMNS]) for a in airports}

    def facts(rows: Column, airport: str | None) -> Column:
        held = [F.bool_or(rows & F.col(c).isNotNull()).alias(c) for c in SITE_COLUMNS]
        named = [F.bool_or(rows & _names(airport, c)).alias(f"named_{c}") for c in ("origin", "airport")] if airport else []
        return F.struct(F.bool_or(rows).alias("rows"), *held, *named)

    told = df.agg(facts(F.lit(True), None).alias("all"), *[facts(anywhere[a], a).alias(f"a{i}") for i, a in enumerate(airports)]).first()
    out = {}
    for i, a in enumerate(airports):
        own = told[f"a{i}"].asDict()
        view = anywhere[a] if own["rows"] else F.lit(True)
        present_ = own if own["rows"] else told["all"].asDict()

        def first_held(column: str, airport: str = a, there: Mapping = present_) -> Column:
            return next((_names(airport, c) for c in (column, "airport") if there[c]), F.lit(True))

        named = next((_names(a, c) for c in ("origin", "airport") if own[f"named_{c}"]), F.lit(True))
        out[a] = {
            "view": view,
            "arrival": view & first_held("destination"),
            "departure": view & first_held("origin"),
            "origin_first": view & named,
            "any": anywhere[a],
        }
    return out


def filter_dates(df: DataFrame, start: date | str, end: date | str | None = None) -> DataFrame:
    """Rows with ``date`` in the inclusive range; reversed ends are swapped, one date means that day."""
    ends = (start, start if end is None else end)
    low, high = sorted(date.fromisoformat(d) if isinstance(d, str) else d for d in ends)
    return df.filter(F.col("date").between(F.lit(low), F.lit(high)))


def ensure_date(df: DataFrame, as_of: date) -> DataFrame:
    """Guarantee ``date``: itself, else the day of the first time column with any value."""
    sources = ["date", "sched_dep", "sched_arr", "act_dep", "act_arr"]
    held = presence(df, sources)
    source = next((c for c in sources if held[c]), None)
    return df.withColumn("date", F.lit(as_of) if source is None else F.to_date(F.col(source)))


def ops_view(df: DataFrame, as_of: date) -> DataFrame:
    """History mapped onto one day: scheduled departures keep their clock."""
    return df.withColumn("sched_dep", clock_on("sched_dep", F.lit(as_of)))


def primary_time() -> Column:
    return F.coalesce(F.col("sched_dep"), F.col("sched_arr"))


def schedule_time(df: DataFrame) -> DataFrame:
    """Departure schedule; only when it is entirely empty, actual departure or arrival schedule."""
    if not has_any(df, F.col("sched_dep").isNotNull()):
        df = df.withColumn("sched_dep", F.coalesce("act_dep", "sched_arr"))
    return df.filter(F.col("sched_dep").isNotNull())


def next_hours(
    df: DataFrame, as_of: datetime, hours: int = 2, time_col: str = "sched_dep", by: Sequence[str] = ()
) -> DataFrame:
    """Movements of the next hours, with ``win_start``, ``win_end`` and ``from_now``.

    The window starts now; if it is empty it starts at the next departure, and if
    there is none at the first departure.
    """
    now = as_of.replace(second=0, microsecond=0)
    t, until = F.col(time_col), F.lit(now + timedelta(hours=hours))
    start, ahead = F.lit(now), F.lit(now) <= F.col(time_col)
    scoped = with_group_stats(
        df.filter(t.isNotNull()),
        by,
        {
            "__busy": F.coalesce(F.bool_or(ahead & (t < until)), F.lit(False)),
            "__next": F.min(F.when(ahead, t)),
            "__first": F.min(t),
        },
    )
    begin = F.when(F.col("__busy"), start.cast("timestamp_ntz")).otherwise(F.coalesce("__next", "__first"))
    return (
        scoped.withColumns({"win_start": begin, "from_now": F.col("__busy")})
        .withColumn("win_end", add_minutes("win_start", F.lit(60 * hours)))
        .filter((t >= F.col("win_start")) & (t < F.col("win_end")))
        .drop("__busy", "__next", "__first")
    )

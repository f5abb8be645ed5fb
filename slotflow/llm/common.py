"""Small helpers that several of these operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, parts: int = 4) -> Column:
    """crc32 of the key as text, modulo ``parts``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def held_out(key: Column) -> Column:
    """The fold kept away from every fit. A row without a key is neither held out nor learned from."""
    return F.coalesce(remainder(key) == 2, F.lit(False))


def learnable(key: Column) -> Column:
    return F.coalesce(remainder(key) != 2, F.lit(False))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that does not clash with those taken (Spark ignores case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under own names, so that extra columns of the input cannot clash."""
    return df.select(*(df[quoted(source)].alias(name) for name, source in columns.items()))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

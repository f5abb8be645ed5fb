"""Header names: uniqueness and mapping onto the canonical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotflow.functions.text import HEADER_WORDS, SPACE, SYNONYMS, normalise_token, normalise_word


def detect_columns(names: Sequence[str]) -> dict[str, str]:
    """Canonical column -> first header that is one of its spellings."""
    first = {normalise_word(name): name for name in reversed(names)}
    ranked = {c: min((names.index(first[w]) for w in words if w in first), default=-1) for c, words in SYNONYMS.items()}
    return {c: names[at] for c, at in ranked.items() if at >= 0}


_CELL_END = "\x1f"  # joins cells; header words cannot contain it
_PAD = f"[{SPACE.replace(_CELL_END, '')}]*"
_HEADER_CELL = rf"(?<={_CELL_END}){_PAD}(?:{'|'.join(HEADER_WORDS)}){_PAD}(?={_CELL_END})"


def _plain(text: Column) -> Column:
    return F.translate(F.lower(text), " _", "")


def holds_header_word(text: Column) -> Column:
    """Does the text hold a header word anywhere? Cheap, and true of every text that holds a header cell."""
    return F.rlike(_plain(text), F.lit("|".join(HEADER_WORDS)))


def looks_like_header(cells: Column, min_hits: int = 2) -> Column:
    """A row of cells is a header when at least ``min_hits`` of them are header words.

    The row is joined and searched as one text, which stays in generated code.
    """
    joined = F.concat(F.lit(_CELL_END), F.concat_ws(_CELL_END, cells), F.lit(_CELL_END))
    return F.regexp_count(_plain(joined), F.lit(_HEADER_CELL)) >= min_hits


def unique_header_names(headers: DataFrame, keys: Sequence[str], cells: str) -> DataFrame:
    """(keys, pos, name): the cells of header rows as unique names."""
    named = headers.select(*keys, F.posexplode(cells).alias("pos", "raw")).withColumn(
        "raw", F.coalesce(F.col("raw"), F.lit(""))
    )
    # a group is one header word of one header row
    nth = F.row_number().over(Window.partitionBy(*keys, "raw").orderBy("pos")) - 1
    return named.withColumn("nth", nth).select(
        *keys,
        "pos",
        F.when(F.col("nth") == 0, F.col("raw")).otherwise(F.concat_ws(".", "raw", F.col("nth").cast("string"))).alias("name"),
    )


def live_words(header: Column, live: Column) -> Column:
    """(pos, word) of the live header cells in normal form: worked out once for all canonical columns.

    A repeated header is left out: its unique name carries a suffix.
    """
    told = lambda c, i: F.struct(i.alias("pos"), normalise_token(c).alias("word"), (F.array_position(header, c) == i + 1).alias("first"))
    return F.filter(F.transform(header, told), lambda x: x["first"] & F.array_contains(live, x["pos"]))


def column_position(words: Column, canonical: str) -> Column:
    """0-based position of the first of ``live_words`` that spells ``canonical``."""
    spelled = F.filter(words, lambda x: x["word"].isin(SYNONYMS[canonical]))
    return F.array_min(F.transform(spelled, lambda x: x["pos"]))

"""Human-readable movement labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotflow.functions.ordered import fill_forward, row_bin
from slotflow.functions.text import blank_null_words, clean_flight_number, join_carrier

_FILE = ["__file", "__sheet"]


def _label(number: Column) -> Column:
    carrier = F.upper(blank_null_words(F.col("carrier")))
    origin = F.upper(blank_null_words(F.col("origin")))
    destination = F.upper(blank_null_words(F.col("destination")))
    tail = F.upper(blank_null_words(F.col("tail_number")))
    route = F.when((origin != "") & (destination != ""), F.concat(origin, F.lit("→"), destination)).otherwise(
        F.concat(origin, destination)
    )
    when = F.coalesce(F.date_format("sched_dep", "dd-MMM HH:mm"), F.lit(""))
    main = F.trim(F.concat_ws(" ", join_carrier(carrier, number), route))
    extra = [F.when(part != "", F.concat(F.lit(" · "), part)).otherwise("") for part in (when, tail)]
    return F.trim(F.concat(main, *extra))


def movement_labels(df: DataFrame) -> DataFrame:
    """Add ``label``: ``CARRIER+NO ORIG→DEST · dd-Mon HH:MM · TAIL``.

    A missing flight number takes the last one above it in the same file and sheet.
    """
    prepared = df.withColumns(
        {
            "__file": F.coalesce("source_file", F.lit("")),
            "__sheet": F.coalesce("sheet", F.lit("")),
            "__chunk": row_bin(),
            "__fno": F.nullif(clean_flight_number(F.col("flight_number")), F.lit("")),
        }
    )
    filled = fill_forward(prepared, _FILE, "__fno", "__chunk", "row_id", "__number")
    return filled.withColumn("label", _label(F.coalesce(F.col("__number"), F.lit("")))).drop(
        *_FILE, "__chunk", "__fno", "__number"
    )


def label_lookup(df: DataFrame) -> DataFrame:
    """(flight_id, label): the first label of each flight id, the id itself where there is none."""
    own = blank_null_words(F.col("flight_id"))
    labelled = movement_labels(df).withColumn("label", F.when(F.col("label") != "", F.col("label")).otherwise(own))
    return labelled.groupBy("flight_id").agg(F.min_by("label", "row_id").alias("label"))


def show_labels(table: DataFrame, base: DataFrame) -> DataFrame:
    """Replace the flight ids of a result table by labels taken from ``base``."""
    lookup = label_lookup(base).select(F.col("flight_id").alias("__id"), F.col("label").alias("__label"))
    rest = [c for c in table.columns if c != "flight_id"]
    return table.join(lookup, F.col("flight_id") == F.col("__id"), "left").select(
        F.coalesce("__label", "flight_id").alias("flight_id"), *rest
    )

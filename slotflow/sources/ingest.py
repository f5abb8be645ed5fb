"""Raw schedule tables to canonical movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotflow.functions.ordered import fill_forward
from slotflow.functions.text import clean_token, flight_id
from slotflow.functions.times import minutes_between, parse_day, resolve_times
from slotflow.schema import MOVEMENT_SCHEMA
from slotflow.session import cut_lineage
from slotflow.sources.columns import detect_columns
from slotflow.sources.delimited import read_csv_files
from slotflow.sources.sinks import write_movements
from slotflow.sources.tables import read_blocks, read_movements

_PLAIN = ("origin", "destination", "carrier", "flight_number", "tail_number", "runway", "gate", "airport")
_TIMES = ("sched_dep", "act_dep", "sched_arr", "act_arr")


def normalise_times(raw: DataFrame, cols: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns from raw text: sites, ids, filled dates and resolved times.

    ``raw`` needs ``row_id``; ``file_part`` (runs of consecutive rows) bounds the work
    of the date fill. A date applies to the rows below it in the same file and sheet,
    and to those above the first one.
    """
    cols = detect_columns(raw.columns) if cols is None else cols

    def source(name: str) -> Column:
        return F.col(f"`{cols[name]}`") if name in cols else F.lit(None).cast("string")

    have = set(raw.columns)
    optional = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    staged = raw.select(
        "row_id",
        (F.col("file_part") if "file_part" in have else F.shiftright("row_id", 16)).alias("__part"),
        optional("source_file").alias("source_file"),
        optional("sheet").alias("sheet"),
        F.coalesce(optional("source_file"), F.lit("")).alias("__file"),
        F.coalesce(optional("sheet"), F.lit("")).alias("__sheet"),
        parse_day(clean_token(source("date"))).alias("__day"),
        *[clean_token(source(c)).alias(c) for c in (*_PLAIN, *_TIMES)],
    )
    if "date" in cols:
        staged = fill_forward(staged, ["__file", "__sheet"], "__day", "__part", "row_id", "date", then_back=True)
    else:
        staged = staged.withColumn("date", F.col("__day"))
    return resolve_times(staged, _TIMES, "date").drop("__part", "__file", "__sheet", "__day")


def compute_basic_features(df: DataFrame) -> DataFrame:
    """Delays in minutes and the flight id."""
    return df.withColumns(
        {
            "dep_delay_min": minutes_between("act_dep", "sched_dep"),
            "arr_delay_min": minutes_between("act_arr", "sched_arr"),
            "flight_id": flight_id(F.col("carrier"), F.col("flight_number"), F.col("row_id")),
        }
    )


def to_movements(raw: DataFrame, cols: dict[str, str] | None = None) -> DataFrame:
    return compute_basic_features(normalise_times(raw, cols)).select(*MOVEMENT_SCHEMA.names)


def read_and_normalize(cells: DataFrame, sheet: str | None = None, simple: bool = False) -> DataFrame:
    """Cell table to movements in one go: all sheets or one, by blocks or with row 0 as the header.

    Where no block has a row, row 0 of each sheet is taken as the header after all.
    """
    chosen = cells if sheet is None else cells.filter(F.col("sheet") == sheet)
    return to_movements(read_blocks(chosen, simple, or_simple=not simple))


def ingest(
    spark: SparkSession, path: str, fmt: str | None = None, sheet: str | None = None, simple: bool = False
) -> DataFrame:
    """Movements from a file or folder.

    ``csv``: every file in its own dialect; ``cells``: parquet of (source_file, sheet, row_idx,
    cells), of which ``sheet`` picks one sheet and ``simple`` takes row 0 as the only header;
    ``parquet``: canonical columns. The format defaults to the extension. What is parsed from
    text is written to the checkpoint folder once, so that metrics do not parse it again.
    """
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind == "csv":
        out = cut_lineage(to_movements(read_csv_files(spark, path)))
    elif kind == "cells":
        out = cut_lineage(read_and_normalize(spark.read.parquet(path), sheet, simple))
    elif kind == "parquet":
        out = read_movements(spark, path)
    else:
        raise ValueError(f"unsupported file type {kind!r}: use csv, cells or parquet")
    if out.isEmpty():
        raise ValueError(f"no rows read from {path}")
    return out


def run_ingest(spark: SparkSession, path: str, out_path: str, fmt: str | None = None) -> str:
    """Ingest and write parquet partitioned by date."""
    return write_movements(ingest(spark, path, fmt), out_path)

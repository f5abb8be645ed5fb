"""Scans: parquet, and cell tables with several blocks per sheet."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotflow.functions.ordered import fill_forward, join_null_safe, running
from slotflow.functions.text import SYNONYMS, is_filled
from slotflow.schema import conform
from slotflow.session import cut_lineage
from slotflow.sources.columns import column_position, live_words, looks_like_header

FILE_SPAN = 40  # row ids leave 2**40 positions per file


def read_movements(spark: SparkSession, path: str) -> DataFrame:
    """Canonical movements from parquet; columns not used later are pruned from the scan.

    Files without ``row_id`` get one from the source: file by name, then row in the file.
    """
    rows = spark.read.parquet(path)
    if "row_id" in rows.columns:
        return conform(rows)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = number_rows(spark.read.parquet(path).select(F.col("_metadata.file_path").alias("__file")).distinct(), ["__file"], "__no")
    joined = placed.join(files, "__file")
    return conform(joined.withColumn("row_id", row_id(F.col("__no"), F.col("__row"), FILE_SPAN)).drop("__file", "__row", "__no"))


def row_id(major: Column, minor: Column, bits: int) -> Column:
    """Both numbers in one long, in order; fails where one of them has too many digits."""
    fits = (minor >= 0) & (minor < F.lit(1 << bits)) & (major < F.lit(1 << (63 - bits)))
    return F.when(fits, F.shiftleft(major.cast("bigint"), bits) + minor).otherwise(
        F.raise_error(F.lit("more rows or sources than row ids can express")).cast("bigint")
    )


def number_rows(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Consecutive numbers from 0 along ``order``, which tells the rows apart: sources, not their rows.

    The rows are written once, and cut into blocks only where they are more than one holds.
    """
    held = cut_lineage(df)
    numbered = running(held, [], order, {out: F.lit(1)})
    return numbered.withColumn(out, F.col(out) - 1)


# ---- cell tables --------------------------------------------------------------------

_SHEET = ["source_file", "sheet"]
_BLOCK = [*_SHEET, "header_idx"]
_CHUNK_BITS = 16


def has_text(cells: Column) -> Column:
    return is_filled(F.concat_ws("", cells))


def locate_blocks(cells: DataFrame) -> DataFrame:
    """Add ``is_header`` and ``header_idx``, the header row each row belongs to.

    That is the nearest header row above; in a sheet without any, row 0. Rows above
    the first header get a later ``header_idx`` and belong to no block.
    """
    flagged = cells.withColumns(
        {
            "is_header": looks_like_header(F.col("cells")),
            "__chunk": F.shiftright(F.col("row_idx"), _CHUNK_BITS),
        }
    ).withColumn("__h", F.when(F.col("is_header"), F.col("row_idx")))
    flagged = cut_lineage(flagged)  # the fill reads the rows three times
    found = fill_forward(flagged, _SHEET, "__h", "__chunk", "row_idx", "__found", then_back=True)
    return found.withColumns(
        {"header_idx": F.coalesce(F.col("__found"), F.lit(0).cast("bigint")), "detected": F.col("__found").isNotNull()}
    ).drop("__h", "__chunk", "__found")


def block_layout(rows: DataFrame) -> DataFrame:
    """One row per kept block: for each canonical column its position in the cells (or NULL).

    Columns without any value are ignored. A block needs a row, and three columns
    with values if its header was detected.
    """
    body = rows.filter((F.col("row_idx") > F.col("header_idx")) & has_text(F.col("cells")))
    # Rows of a block fill few different sets of columns: those are told apart, not the cells.
    filled = F.array_compact(F.transform("cells", lambda c, i: F.when(is_filled(c), i)))
    live = (
        body.select(*_BLOCK, filled.alias("at"))
        .distinct()
        .select(*_BLOCK, F.explode("at").alias("pos"))
        .groupBy(*_BLOCK)
        .agg(F.collect_set("pos").alias("live"))
    )
    headers = rows.filter(F.col("row_idx") == F.col("header_idx")).select(*_BLOCK, "detected", F.col("cells").alias("header"))
    kept = join_null_safe(headers, live, _BLOCK).filter(~F.col("detected") | (F.size("live") >= 3))
    worded = kept.withColumn("words", live_words(F.col("header"), F.col("live")))
    return worded.select(*_BLOCK, *[column_position(F.col("words"), c).alias(c) for c in SYNONYMS])


def one_block(cells: DataFrame) -> DataFrame:
    """Every sheet as one block whose header is row 0, with the columns of :func:`locate_blocks`."""
    return cells.withColumns({"is_header": F.col("row_idx") == 0, "header_idx": F.lit(0).cast("bigint"), "detected": F.lit(False)})


def read_blocks(cells: DataFrame, simple: bool = False, or_simple: bool = False) -> DataFrame:
    """Rows of all blocks of all sheets with canonical text columns.

    ``cells`` has (source_file, sheet, row_idx, cells); ``simple`` takes row 0 of a sheet as
    its only header, ``or_simple`` does so where no block has a row. The layout table has one row
    per block; it and the rows come from one written pass over the cells.
    """
    rows = one_block(cells) if simple else cut_lineage(locate_blocks(cells))
    layout = cut_lineage(block_layout(rows))
    if or_simple and layout.isEmpty():
        return read_blocks(cells, simple=True)
    layout = join_null_safe(layout, number_rows(layout.select(*_SHEET).distinct(), _SHEET, "__no"), _SHEET)
    body = rows.filter((F.col("row_idx") > F.col("header_idx")) & has_text(F.col("cells")))
    cell = lambda c: F.get(F.col("cells"), F.col(f"__l.{c}"))
    picked = [F.when(is_filled(cell(c)), cell(c)).alias(c) for c in SYNONYMS]
    return (
        join_null_safe(body, layout.select(*_BLOCK, "__no", F.struct(*SYNONYMS).alias("__l")), _BLOCK)
        .select(
            row_id(F.col("__no"), F.col("row_idx"), 32).alias("row_id"),
            *_SHEET,
            F.shiftright(F.col("row_idx"), _CHUNK_BITS).alias("file_part"),
            *picked,
        )
    )


def union_sheets(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows by column name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

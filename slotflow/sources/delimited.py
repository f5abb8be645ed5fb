"""CSV files of unknown dialect, read as lines and parsed by column expressions.

Separator, charset and header are a profile row of each file, so that files of all dialects
go through the same scan. Files are read in splits even if quoted cells hold line breaks: a
line maps "outside a quoted cell" and "inside one" each to one of the two. These maps are put
together along a split, then along the splits of a file, which tells where every
split's first record begins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotflow.functions.text import SYNONYMS
from slotflow.session import cut_lineage
from slotflow.sources.columns import column_position, holds_header_word, live_words, looks_like_header
from slotflow.sources.tables import FILE_SPAN, has_text, number_rows, row_id

SEPARATORS = [",", ";", "|", "\t"]
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'


def _cell(sep: str) -> str:
    """Pattern of a whole cell: quoted, with anything up to the separator behind it, or bare."""
    other = "[^|]" if sep == "|" else f"[^{sep}]"
    return f'(?:{_QUOTED}{other}*+|(?!"){other}*+)'


def _escaped(sep: str) -> str:
    return "\\|" if sep == "|" else sep


def _by_separator(sep: Column, build) -> Column:
    """The expression of the row's separator; each has a constant pattern, which is compiled once, not for every row."""
    out = build(SEPARATORS[0])
    for s in SEPARATORS[1:]:
        out = F.when(sep == s, build(s)).otherwise(out)
    return out


def cells_of(line: Column, sep: Column) -> Column:
    """The cells of a record, without their quotes."""
    record = F.concat(sep, F.regexp_replace(line, "\r$", ""))
    found = _by_separator(sep, lambda s: F.regexp_extract_all(record, F.lit(f"(?s){_escaped(s)}({_cell(s)})"), F.lit(1)))
    bare = lambda c: F.replace(F.regexp_replace(c, f"(?s)^\"([^\"]*+(?:\"\"[^\"]*+)*+)\"", "$1"), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when(F.startswith(c, F.lit('"')), bare(c)).otherwise(c))


def _whole(line: Column, sep: Column) -> Column:
    """Does every cell that begins on the line end on it?"""
    return _by_separator(sep, lambda s: F.rlike(line, F.lit(f"(?s)^{_cell(s)}(?:{_escaped(s)}{_cell(s)})*+$")))


def _cp1252_map() -> tuple[str, str]:
    """Control characters that ISO-8859-1 yields, and the letters and signs meant by them."""
    pairs = []
    for code in range(0x80, 0xA0):
        try:
            pairs.append((chr(code), bytes([code]).decode("cp1252")))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _text(value: Column, broken: Column) -> Column:
    """A line without a byte order mark; files that are not valid UTF-8 hold cp1252."""
    decoded = F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), *_cp1252_map())
    return F.ltrim(F.when(broken, decoded).otherwise(value), F.lit("\ufeff"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("file_part"),
        F.monotonically_increasing_id().alias("__pos"),
    )


def csv_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, sep, broken) of every file, from one distributed pass.

    The separator is the one that cuts the file's header into most cells. That is the first line
    that holds header words, else the first with text: blank lines and titles come before it.
    ``broken`` files are not valid UTF-8.
    """
    lines = _lines(spark, path)
    line = F.ltrim(F.col("value"), F.lit("\ufeff"))
    bare = F.replace(line, F.lit('"'), F.lit(""))
    # lines without any header word, as most are, need not be split
    known = F.when(holds_header_word(bare), reduce(lambda a, b: a | b, [looks_like_header(F.split(bare, _escaped(s), -1)) for s in SEPARATORS]))
    at = F.struct("file_part", "__pos")
    files = lines.groupBy("file").agg(
        F.min_by(line, F.when(known, at)).alias("header"),
        F.min_by(line, F.when(F.trim(line) != "", at)).alias("first"),
        F.bool_or(~F.is_valid_utf8("value")).alias("broken"),
    )
    bare = F.regexp_replace(F.coalesce("header", "first", F.lit("")), _QUOTED, "")
    splits = [F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(s)))).alias("n"), F.lit(-i).alias("rank"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS)]
    return files.select("file", F.array_max(F.array(*splits))["sep"].alias("sep"), "broken")


def _states(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``known`` and ``flips``: what precedes a row, as the state it starts with or as flips of an unknown one.

    ``fixed`` (0 outside, 1 inside, or NULL) is the state after a row that does not depend on
    the state before; ``flip`` is 1 for a row that turns the state.
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    base = F.pmod(F.col("fixed") - F.col("__upto"), F.lit(2))
    return (
        df.withColumns({"__upto": F.sum("flip").over(upto), "flips": F.coalesce(F.sum("flip").over(before), F.lit(0))})
        .withColumn("__base", F.when(F.col("fixed").isNotNull(), base))
        .withColumn("known", F.last("__base", True).over(before) + F.col("flips"))
        .drop("__upto", "__base")
    )


def _state(given: Column) -> Column:
    """The state before a row, where ``given`` holds before the rows of :func:`_states`."""
    return F.pmod(F.coalesce("known", given + F.col("flips")), F.lit(2))


def _after(before: Column) -> Column:
    return F.coalesce("fixed", F.pmod(before + F.col("flip"), F.lit(2)))


def _split_table(lines: DataFrame) -> DataFrame:
    """One row per split: the state it starts with, whether a record of it goes on in a line, and what its first lines continue.

    A file whose last quote is never closed has no quoted line breaks: all its states are 0.
    """
    started = lambda h: F.max(F.when(_state(F.lit(h)) == 0, F.col("__nth")))
    last = lambda c: F.max_by(c, F.col("__nth"))
    ways = {f"{name}{h}": f(h) for h in (0, 1) for name, f in (("end", lambda h: last(_after(_state(F.lit(h))))), ("start", started), ("breaks", lambda h: F.max(_after(_state(F.lit(h))))))}
    splits = lines.groupBy("file", "file_part").agg(*[c.alias(n) for n, c in ways.items()])
    maps = splits.withColumns(
        {"fixed": F.when(F.col("end0") == F.col("end1"), F.col("end0")), "flip": F.when(F.col("end0") > F.col("end1"), 1).otherwise(0)}
    )
    told = _states(maps, ["file"], ["file_part"]).withColumn("before", _state(F.lit(0)))
    start, breaks = (F.when(F.col("before") == 0, F.col(f"{n}0")).otherwise(F.col(f"{n}1")) for n in ("start", "breaks"))
    whole = Window.partitionBy("file")  # splits of a file
    earlier = whole.orderBy("file_part").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max_by(_after(F.col("before")), F.col("file_part")).over(whole)
    return (
        told.withColumns({"open": end == 1, "__start": F.when(start.isNotNull(), F.struct("file_part", start.alias("nth")))})
        .withColumn("owner", F.last("__start", True).over(earlier))
        .select(F.col("file").alias("s_file"), F.col("file_part").alias("s_part"), F.when(F.col("open"), 0).otherwise(F.col("before")).alias("before"), (~F.col("open") & (breaks == 1)).alias("breaks"), "open", "owner")
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_part, nth, cells, sep): the records of all files, by the split and line they begin at."""
    profiles = cut_lineage(csv_profiles(spark, path))
    along = Window.partitionBy("file", "file_part").orderBy("__pos")  # lines of a split
    text = _lines(spark, path).join(profiles, "file").withColumn("line", _text(F.col("value"), F.col("broken")))
    outside, inside = ~_whole(F.col("line"), F.col("sep")), ~_whole(F.concat(F.lit('"'), F.col("line")), F.col("sep"))
    mapped = text.withColumns(
        {
            "fixed": F.when(outside == inside, outside.cast("int")),
            "flip": F.when(outside & ~inside, 1).otherwise(0),
            "__nth": F.row_number().over(along),
        }
    ).select("file", "file_part", "__pos", "__nth", "line", "sep", "fixed", "flip")
    # written once: the split table and the records both read it
    lines = cut_lineage(_states(mapped, ["file", "file_part"], ["__pos"]))
    splits = cut_lineage(_split_table(lines))
    placed = lines.join(splits, (F.col("file") == F.col("s_file")) & (F.col("file_part") == F.col("s_part")))
    if splits.filter("breaks").isEmpty():  # every record is a line
        return placed.select("file", "file_part", F.col("__nth").alias("nth"), cells_of(F.col("line"), F.col("sep")).alias("cells"))
    before = F.when(F.col("open"), 0).otherwise(_state(F.col("before")))
    after = F.when(F.col("open"), 0).otherwise(_after(before))
    stated = placed.withColumns({"__in": before, "__out": after})
    mine = F.last(F.when(F.col("__in") == 0, F.struct("file_part", F.col("__nth").alias("nth"))), True).over(along)
    alone = (F.col("__in") == 0) & (F.col("__out") == 0)
    single = stated.filter(alone).select("file", "file_part", F.col("__nth").alias("nth"), "line", "sep")
    parts = stated.withColumn("__own", F.coalesce(mine, "owner")).filter(~alone)
    piece = F.struct("file_part", "__nth", "line")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["line"]), "\n")
    several = (
        parts.groupBy("file", F.col("__own.file_part").alias("file_part"), F.col("__own.nth").alias("nth"))
        .agg(joined.alias("line"), F.first("sep").alias("sep"))
        .select(*single.columns)
    )
    return single.unionByName(several).select("file", "file_part", "nth", cells_of(F.col("line"), F.col("sep")).alias("cells"))


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Canonical text columns of CSV files, each read as it is: separator, charset, header, line breaks.

    A file's header is its first record with header words, else its first with text; what stands
    above it is left out; lines end in LF or CRLF. Adds ``row_id``, ``source_file`` and ``file_part`` in file order. Empty
    files, empty cells and columns without a known header give nothing.
    """
    # written once: headers and rows both read the cells
    records = cut_lineage(csv_records(spark, path)).filter(has_text(F.col("cells")))
    at = F.struct("file_part", "nth")
    heads = records.groupBy("file").agg(
        F.min_by(F.struct(at.alias("at"), "cells"), F.when(looks_like_header(F.col("cells")), at)).alias("named"), F.min(F.struct(at.alias("at"), "cells")).alias("first")
    )
    head = F.coalesce("named", "first")
    every = F.sequence(F.lit(0), F.size(head["cells"]) - 1)
    places = F.struct(*[column_position(F.col("__words"), c).alias(c) for c in SYNONYMS])
    worded = heads.withColumn("__words", live_words(head["cells"], every))
    layout = number_rows(worded.select("file", head["at"].alias("__at"), places.alias("__l")), ["file"], "__no")
    # Every line takes at least one byte, so split + line number ascends within a file.
    number = row_id(F.col("__no"), F.col("file_part") + F.col("nth") - 1, FILE_SPAN)
    return (
        records.join(layout, "file")
        .filter(at > F.col("__at"))
        .select(number.alias("row_id"), F.col("file").alias("source_file"), "file_part", *[F.nullif(F.get(F.col("cells"), F.col(f"__l.{c}")), F.lit("")).alias(c) for c in SYNONYMS])
    )

"""Checks of text cleaning, time parsing, header detection, ingestion and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slotflow.checks.adapter import (
    CELLS_SQL,
    RAW_HEADERS,
    RAW_SQL,
    cell_rows,
    movements,
    movements_airport_only,
    AIRPORT_ONLY_SQL,
    SHEET_SQL,
    raw_movements,
    strip_sql,
    with_sql,
)
from slotflow.checks.slots import rounded
from slotflow.functions import text, times
from slotflow.functions.text import HEADER_WORDS, SYNONYMS
from slotflow.operators import labels, sites
from slotflow.session import shared_folder
from slotflow.sources import columns, delimited, ingest, sinks, tables

TIME_COLS = ["sched_dep", "act_dep", "sched_arr", "act_arr"]


def clean_tokens(spark, sf):
    return raw_movements(spark, sf).select("row_id", *[text.clean_token(F.col(f"`{c}`")).alias(c.lower()) for c in ("Airline", "ATD", "Gate")])


def parse_times(spark, sf):
    raw = raw_movements(spark, sf).select(
        "row_id", times.parse_day(F.col("Date")).alias("day"), F.lit("1970-01-01").cast("date").alias("zero"), F.col("STD").alias("std")
    )
    return times.resolve_times(raw, ["std"], "zero").drop("zero")


_CLOCK_FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d %I:%M:%S %p', '%Y-%m-%d %I:%M %p']"
_FULL_FORMATS = "['%d/%m/%Y %H:%M', '%Y-%m-%d %H:%M:%S']"


def _clock_sql(c):
    return f"(try_strptime('1970-01-01 ' || \"{c}\", {_CLOCK_FORMATS}) - TIMESTAMP '1970-01-01')"


def _time_sql(c):
    return f"coalesce(try_strptime(\"{c}\", {_FULL_FORMATS}), CAST(day AS TIMESTAMP) + {_clock_sql(c)})"


PARSE_SQL = with_sql(
    f"""
SELECT row_id, CAST(try_strptime("Date", '%d/%m/%Y') AS DATE) AS day,
       coalesce(try_strptime("STD", {_FULL_FORMATS}), TIMESTAMP '1970-01-01' + {_clock_sql('STD')}) AS std FROM raw""",
    RAW_SQL,
)


def _normalised_cte(source, file):
    null = lambda c: f"nullif(nullif({strip_sql(chr(34) + c + chr(34))}, ''), 'nan')"
    return f""",
days AS (
  SELECT *, coalesce(last_value(CAST(try_strptime("Date", '%d/%m/%Y') AS DATE) IGNORE NULLS) OVER up,
                     first_value(CAST(try_strptime("Date", '%d/%m/%Y') AS DATE) IGNORE NULLS) OVER whole) AS day
  FROM {source} WINDOW up AS (PARTITION BY {file} ORDER BY row_id ROWS UNBOUNDED PRECEDING),
                       whole AS (PARTITION BY {file} ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
timed AS (
  SELECT *, {_time_sql('STD')} AS sched_dep, {_time_sql('ATD')} AS act_dep, {_time_sql('STA')} AS sched_arr, {_time_sql('ATA')} AS act_arr,
         coalesce(upper({null('Airline')}), '') AS cc,
         upper(replace(regexp_replace({null('Flight No')}, '^(\\d+)\\.0$', '\\1'), ' ', '')) AS no
  FROM days),
normal AS (
  SELECT row_id, day AS date, {null('From')} AS origin, {null('To')} AS destination, {null('Airline')} AS carrier,
         {null('Flight No')} AS flight_number, {null('Tail')} AS tail_number, {null('Gate')} AS gate, sched_dep, act_dep, sched_arr, act_arr,
         CASE WHEN cc = '' OR (starts_with(no, cc) AND regexp_matches(substr(no, length(cc) + 1, 1), '[0-9]')) THEN no ELSE cc || no END
           AS flight_id,
         date_diff('microsecond', sched_dep, act_dep) / 60e6::DOUBLE AS dep_delay_min,
         date_diff('microsecond', sched_arr, act_arr) / 60e6::DOUBLE AS arr_delay_min
  FROM timed)"""


NORMAL_COLS = "row_id date origin destination carrier flight_number tail_number gate sched_dep act_dep sched_arr act_arr".split()


def normalise_times(spark, sf):
    return ingest.normalise_times(raw_movements(spark, sf)).select(*NORMAL_COLS)


def movement_features(spark, sf):
    out = ingest.to_movements(raw_movements(spark, sf))
    return rounded(out.select("row_id", "flight_id", "dep_delay_min", "arr_delay_min"), "dep_delay_min", "arr_delay_min")


def header_rows(spark, sf):
    return cell_rows(spark, sf).select("source_file", "sheet", "row_idx", columns.looks_like_header(F.col("cells")).alias("is_header"))


def header_names(spark, sf):
    doubled = cell_rows(spark, sf).withColumn("cells", F.concat("cells", F.slice("cells", 1, 2)))
    flagged = doubled.filter(columns.looks_like_header(F.col("cells")))
    return columns.unique_header_names(flagged, ["source_file", "sheet", "row_idx"], "cells")


_HINTS = "[" + ", ".join(f"'{w}'" for w in HEADER_WORDS) + "]"
_IS_HEADER = f"len(list_filter(cells, lambda c: list_contains({_HINTS}, translate(lower({strip_sql('c')}), ' _', '')))) >= 2"


def block_rows(spark, sf):
    out = tables.locate_blocks(cell_rows(spark, sf))
    return out.select("source_file", "sheet", "row_idx", "header_idx", "detected")


def block_layout(spark, sf):
    return tables.block_layout(tables.locate_blocks(cell_rows(spark, sf)))


_BLOCKS = f""",
flagged AS (SELECT *, {_IS_HEADER} AS is_header FROM cell_rows),
found AS (SELECT *, coalesce(max(CASE WHEN is_header THEN row_idx END) OVER (PARTITION BY source_file, sheet ORDER BY row_idx),
                             min(CASE WHEN is_header THEN row_idx END) OVER (PARTITION BY source_file, sheet)) AS h FROM flagged),
located AS (SELECT source_file, sheet, row_idx, cells, coalesce(h, 0) AS header_idx, h IS NOT NULL AS detected FROM found)"""


def _layout_sql():
    picks = []
    for name, words in SYNONYMS.items():
        listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        picks.append(
            f"CAST(min(pos) FILTER (list_contains({listed}, translate(lower({strip_sql('name')}), ' _', ''))) - 1 AS INTEGER) AS {name}"
        )
    return with_sql(
        f"""{_BLOCKS},
body AS (SELECT source_file, sheet, header_idx, unnest(cells) AS cell, generate_subscripts(cells, 1) AS pos FROM located WHERE row_idx > header_idx),
live AS (SELECT DISTINCT source_file, sheet, header_idx, pos FROM body WHERE cell IS NOT NULL),
heads AS (SELECT source_file, sheet, header_idx, unnest(cells) AS name, generate_subscripts(cells, 1) AS pos FROM located WHERE row_idx = header_idx)
SELECT source_file, heads.sheet, header_idx, {', '.join(picks)}
FROM heads JOIN live l USING (source_file, header_idx, pos) WHERE heads.sheet IS NOT DISTINCT FROM l.sheet GROUP BY source_file, heads.sheet, header_idx""",
        CELLS_SQL,
    )


BLOCK_COLS = ["origin", "destination", "sched_dep", "act_dep", "sched_arr", "act_arr", "carrier", "flight_number", "tail_number", "date"]


def read_blocks(spark, sf):
    return tables.read_blocks(cell_rows(spark, sf)).select("source_file", "sheet", *BLOCK_COLS)


READ_BLOCKS_SQL = with_sql(
    f"""
SELECT 'book-' || ((row_id // 60) % 4) AS source_file, {SHEET_SQL.format(no='row_id // 60')} AS sheet, "From" AS origin, "To" AS destination,
       "STD" AS sched_dep, "ATD" AS act_dep, "STA" AS sched_arr, "ATA" AS act_arr, "Airline" AS carrier, "Flight No" AS flight_number,
       "Tail" AS tail_number, "Date" AS date
FROM raw""",
    RAW_SQL,
)


def blocks_to_movements(spark, sf):
    out = ingest.read_and_normalize(cell_rows(spark, sf))
    return out.select("sheet", "flight_id", "date", *TIME_COLS)


def union_sheets(spark, sf):
    raw = raw_movements(spark, sf).select("row_id", "From", "STD")
    other = raw_movements(spark, sf).select("row_id", "To", "STA")
    return tables.union_sheets([raw, other])


def written_movements(spark, sf):
    """Written partitioned by date to the shared folder and read back."""
    path = sinks.write_movements(movements(spark, sf), f"{shared_folder(spark)}/movements-{uuid.uuid4().hex}")
    back = tables.read_movements(spark, path)
    return back.select("row_id", "flight_id", "date", "origin", "sched_dep", "act_arr")


def parquet_without_ids(spark, sf):
    """Parquet as another tool may have written it: no row id, several files."""
    path = f"{shared_folder(spark)}/plain-{uuid.uuid4().hex}"
    movements(spark, sf).drop("row_id").repartition("origin").write.parquet(path)
    back = tables.read_movements(spark, path)
    per_id = back.groupBy("row_id").count().agg(F.max("count").alias("most")).select(F.col("most").cast("string").alias("flight_id"))
    return back.select("flight_id", "origin", "sched_dep").unionByName(per_id, allowMissingColumns=True)


def _titled_files(part, names, sep, path):
    """Text files of many rows each, whose header comes after a blank line and a title."""
    quoted = {"sep": sep, "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    part = part.withColumn("k", F.expr("row_id div 20000"))
    rows = part.select("k", F.col("row_id").alias("at"), F.to_csv(F.struct(*[f"`{h}`" for h in names]), quoted).alias("value"))
    top = ["", "Plan, of, all, flights, and, of, more, days, to, come, by, hand", sep.join(names)]
    heads = part.select("k").distinct().select("k", F.posexplode(F.array(*map(F.lit, top))).alias("at", "value"))
    lines = rows.unionByName(heads.withColumn("at", F.col("at").cast("long") - len(top)))
    lines.repartition("k").sortWithinPartitions("k", "at").select("k", "value").write.partitionBy("k").text(path)


def csv_files(spark, sf):
    """A folder with two column orders, three separators, two charsets, titles and quoted line breaks."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    raw = raw_movements(spark, sf).withColumn("Gate", F.expr(_GATES))
    for kind, (sep, charset) in enumerate([(",", "UTF-8"), (";", "UTF-8"), ("|", "ISO-8859-1")]):
        names = RAW_HEADERS if kind != 1 else RAW_HEADERS[::-1]
        part = raw.filter(F.col("row_id") % 3 == kind)
        if kind == 1:
            _titled_files(part, names, sep, f"{path}/kind-{kind}")
            continue
        writer = part.select(*[f"`{h}`" for h in names]).write.option("header", True).option("sep", sep).option("encoding", charset).option("quoteAll", True)
        writer.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/kind-{kind}")
    return delimited.read_csv_files(spark, f"{path}/*").select(*BLOCK_COLS, "gate")


_GATES = "CASE row_id % 3 WHEN 0 THEN gate || chr(10) || 'L' WHEN 2 THEN gate || chr(233) ELSE gate END"


def one_sheet(spark, sf):
    """The sheet of one name in every book, its first row as the header."""
    no = F.coalesce(F.regexp_extract("sheet", "[0-9]+", 0).cast("long"), F.lit(3))
    named = cell_rows(spark, sf).withColumns({"source_file": F.concat(F.lit("book-"), ((no - no % 5) / 5).cast("long").cast("string")), "sheet": F.concat(F.lit("sheet-"), (no % 5).cast("string"))})
    out = ingest.read_and_normalize(named, sheet="sheet-4", simple=True)
    return out.select("sheet", "flight_id", "date", *TIME_COLS)


def ingest_formats(spark, sf):
    """The same movements ingested from CSV files, from cells and from parquet, by the ending of the path."""
    path = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    raw = raw_movements(spark, sf).withColumn("k", F.expr("row_id div 20000"))
    names = ["k", *[f"`{h}`" for h in RAW_HEADERS]]
    ordered = raw.repartition("k").sortWithinPartitions("k", "row_id").select(*names)
    ordered.write.partitionBy("k").option("header", True).option("quoteAll", True).csv(f"{path}/m.csv")
    cell_rows(spark, sf).write.parquet(f"{path}/m.cells")
    movements(spark, sf).write.parquet(f"{path}/m.parquet")
    parts = [
        ingest.ingest(spark, f"{path}/m.{kind}").select(F.lit(kind).alias("format"), "flight_id", "date", *TIME_COLS)
        for kind in ("csv", "cells", "parquet")
    ]
    return tables.union_sheets(parts)


def movement_labels(spark, sf):
    gaps = movements(spark, sf).withColumn("flight_number", F.when(F.col("gate").isNotNull(), F.col("flight_number")))
    return labels.movement_labels(gaps).select("row_id", "label")


_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def label_sql(number):
    return (
        f"trim(coalesce(CASE WHEN {number} IS NULL THEN '' ELSE carrier || {number} END, '') || ' ' || origin || '→' || destination)"
        f" || ' · ' || strftime(sched_dep, '%d') || '-' || {_MONTHS}[month(sched_dep)] || strftime(sched_dep, ' %H:%M')"
        " || coalesce(' · ' || tail_number, '')"
    )


def flight_labels(spark, sf):
    return labels.label_lookup(movements(spark, sf))


def labelled_delays(spark, sf):
    base = movements(spark, sf)
    worst = base.groupBy("flight_id").agg(F.max("dep_delay_min").alias("worst_delay"))
    return rounded(labels.show_labels(worst, base), "worst_delay")


def cleaned_labels(spark, sf):
    raw = raw_movements(spark, sf)
    return raw.select(
        "row_id",
        text.blank_null_words(F.col("Airline")).alias("airline"),
        text.blank_null_words(F.col("Gate")).alias("gate"),
        text.clean_flight_number(F.col("`Flight No`")).alias("flight_number"),
    )


def airport_options(spark, sf):
    return sites.airport_options(movements(spark, sf))


def airport_names(spark, sf):
    """Site cells that mix codes and words."""
    named = movements_airport_only(spark, sf).withColumn("airport", F.concat_ws(" ", "airport", F.lit("intl"), "carrier"))
    return sites.airport_options(named)


CHECKS = {
    "clean_tokens": (
        clean_tokens,
        with_sql(
            "SELECT row_id, "
            + ", ".join(
                f"CASE WHEN {strip_sql(chr(34) + c + chr(34))} NOT IN ('', '<NA>', 'NaT', 'nan') THEN {strip_sql(chr(34) + c + chr(34))} END AS {c.lower()}"
                for c in ("Airline", "ATD", "Gate")
            )
            + " FROM raw",
            RAW_SQL,
        ),
    ),
    "parse_times": (parse_times, PARSE_SQL),
    "normalise_times": (
        normalise_times,
        with_sql(f"{_normalised_cte('raw', 'source_file')}\nSELECT {', '.join(NORMAL_COLS)} FROM normal", RAW_SQL),
    ),
    "movement_features": (
        movement_features,
        with_sql(
            f"{_normalised_cte('raw', 'source_file')}\nSELECT row_id, flight_id, round(dep_delay_min, 4) + 0.0 AS dep_delay_min, "
            "round(arr_delay_min, 4) + 0.0 AS arr_delay_min FROM normal",
            RAW_SQL,
        ),
    ),
    "header_rows": (
        header_rows,
        with_sql(f"\nSELECT source_file, sheet, row_idx, {_IS_HEADER} AS is_header FROM cell_rows", CELLS_SQL),
    ),
    "header_names": (
        header_names,
        with_sql(
            f""",
heads AS (SELECT source_file, sheet, row_idx, list_concat(cells, cells[1:2]) AS cells FROM cell_rows WHERE {_IS_HEADER.replace('cells', 'list_concat(cells, cells[1:2])')}),
named AS (SELECT source_file, sheet, row_idx, unnest(cells) AS raw, generate_subscripts(cells, 1) - 1 AS pos FROM heads),
counted AS (SELECT *, row_number() OVER (PARTITION BY source_file, sheet, row_idx, raw ORDER BY pos) - 1 AS nth FROM named)
SELECT source_file, sheet, row_idx, CAST(pos AS INTEGER) AS pos, CASE WHEN nth = 0 THEN raw ELSE raw || '.' || nth END AS name FROM counted""",
            CELLS_SQL,
        ),
    ),
    "block_rows": (
        block_rows,
        with_sql(f"{_BLOCKS}\nSELECT source_file, sheet, row_idx, header_idx, detected FROM located", CELLS_SQL),
    ),
    "block_layout": (block_layout, _layout_sql()),
    "read_blocks": (read_blocks, READ_BLOCKS_SQL),
    "blocks_to_movements": (
        blocks_to_movements,
        with_sql(
            _normalised_cte("raw", "row_id // 60") + f"\nSELECT {SHEET_SQL.format(no='row_id // 60')} AS sheet, flight_id, date, "
            "sched_dep, act_dep, sched_arr, act_arr FROM normal",
            RAW_SQL,
        ),
    ),
    "parquet_without_ids": (
        parquet_without_ids,
        with_sql("SELECT flight_id, origin, sched_dep FROM movements UNION ALL SELECT '1', NULL, NULL"),
    ),
    "csv_files": (
        csv_files,
        with_sql(
            f"""
SELECT "From" AS origin, "To" AS destination, "STD" AS sched_dep, "ATD" AS act_dep, "STA" AS sched_arr, "ATA" AS act_arr,
       "Airline" AS carrier, "Flight No" AS flight_number, "Tail" AS tail_number, "Date" AS date, {_GATES.replace("gate", '"Gate"')} AS gate
FROM raw""",
            RAW_SQL,
        ),
    ),
    "one_sheet": (
        one_sheet,
        with_sql(
            _normalised_cte("raw", "row_id // 60") + "\nSELECT 'sheet-4' AS sheet, flight_id, date, sched_dep, act_dep, sched_arr, act_arr "
            "FROM normal WHERE row_id // 60 % 5 = 4",
            RAW_SQL,
        ),
    ),
    "ingest_formats": (
        ingest_formats,
        with_sql(
            _normalised_cte("raw", "row_id // 20000")
            + _normalised_cte("raw", "row_id // 60").replace("days AS", "days2 AS").replace("FROM days)", "FROM days2)").replace("timed AS", "timed2 AS").replace("FROM timed)", "FROM timed2)").replace("normal AS", "normal2 AS")
            + "".join(
                f"\n{'UNION ALL ' if i else ''}SELECT '{kind}' AS format, flight_id, date, sched_dep, act_dep, sched_arr, act_arr FROM {source}"
                for i, (kind, source) in enumerate([("csv", "normal"), ("cells", "normal2"), ("parquet", "movements")])
            ),
            RAW_SQL,
        ),
    ),
    "union_sheets": (
        union_sheets,
        with_sql(
            '\nSELECT row_id, "From", "STD", NULL::VARCHAR AS "To", NULL::VARCHAR AS "STA" FROM raw\n'
            'UNION ALL SELECT row_id, NULL, NULL, "To", "STA" FROM raw',
            RAW_SQL,
        ),
    ),
    "written_movements": (written_movements, with_sql("SELECT row_id, flight_id, date, origin, sched_dep, act_arr FROM movements")),
    "cleaned_labels": (
        cleaned_labels,
        with_sql(
            """
SELECT row_id, coalesce(nullif(AIRLINE, 'nan'), '') AS airline, coalesce("Gate", '') AS gate,
       upper(replace(regexp_replace("Flight No", '^(\\d+)\\.0$', '\\1'), ' ', '')) AS flight_number
FROM raw""".replace("AIRLINE", strip_sql('"Airline"')),
            RAW_SQL,
        ),
    ),
    "movement_labels": (
        movement_labels,
        with_sql(
            f""",
gaps AS (SELECT *, last_value(CASE WHEN gate IS NOT NULL THEN flight_number END IGNORE NULLS) OVER (ORDER BY row_id) AS fno FROM movements)
SELECT row_id, {label_sql('fno')} AS label FROM gaps"""
        ),
    ),
    "flight_labels": (
        flight_labels,
        with_sql(f"SELECT flight_id, arg_min({label_sql('flight_number')}, row_id) AS label FROM movements GROUP BY flight_id"),
    ),
    "labelled_delays": (
        labelled_delays,
        with_sql(
            f"SELECT arg_min({label_sql('flight_number')}, row_id) AS flight_id, round(max(dep_delay_min), 4) + 0.0 AS worst_delay "
            "FROM movements GROUP BY movements.flight_id"
        ),
    ),
    "airport_options": (
        airport_options,
        with_sql("""
SELECT row_number() OVER (ORDER BY n DESC, airport) AS rank, airport, n AS mentions
FROM (SELECT airport, count(*) AS n FROM (SELECT origin AS airport FROM movements UNION ALL SELECT destination FROM movements) GROUP BY airport)
ORDER BY rank LIMIT 30"""),
    ),
    "airport_names": (
        airport_names,
        with_sql(
            """,
kinds AS (SELECT 1 AS kind, airport AS name, count(*) AS n FROM movements_airport_only GROUP BY ALL
          UNION ALL SELECT 2, 'Intl', count(*) FROM movements_airport_only)
SELECT row_number() OVER (ORDER BY kind, n DESC, name) AS rank, name AS airport, n AS mentions FROM kinds""",
            AIRPORT_ONLY_SQL,
        ),
    ),
}

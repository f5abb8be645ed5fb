"""Movement tables derived from the ``events`` table, in Spark and as SQL text.

The given tables hold no flights. Each view here turns every event into a movement;
the SQL twin builds the same rows for the independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotflow.schema import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # naive timestamps mean what they say
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = "element_at(array('BOM','DEL','BLR','HYD','MAA'), CAST({} AS INT) + 1)"
    minute = "CAST(date_trunc('minute', ts) AS TIMESTAMP_NTZ)"
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id AS row_id",
        "element_at(array('AI','6E','9W','UK','SG'), CAST(user_id % 5 AS INT) + 1) AS carrier",
        "CAST(100 + event_id % 400 AS STRING) AS flight_number",
        site.format("event_id % 5") + " AS origin",
        site.format("(event_id + 1 + user_id % 4) % 5") + " AS destination",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'VT-' || lpad(CAST(user_id AS STRING), 4, '0') END AS tail_number",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'G' || CAST(user_id % 20 AS STRING) END AS gate",
        f"{minute} AS sched_dep",
        f"{minute} + make_dt_interval(0, 0, 60 + CAST(event_id % 120 AS INT)) AS sched_arr",
        "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) - 1800 END AS dep_s",
        "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) - 1500 END AS arr_s",
    )
    return conform(
        base.selectExpr(
            "*",
            "carrier || flight_number AS flight_id",
            "CAST(sched_dep AS DATE) AS date",
            "sched_dep + make_dt_interval(0, 0, 0, dep_s) AS act_dep",
            "sched_arr + make_dt_interval(0, 0, 0, arr_s) AS act_arr",
            "dep_s / 60.0D AS dep_delay_min",
            "arr_s / 60.0D AS arr_delay_min",
        )
    )


MOVEMENTS_SQL = """
movements AS (
  SELECT row_id, carrier || flight_number AS flight_id, CAST(sched_dep AS DATE) AS date, carrier, flight_number,
         origin, destination, CAST(NULL AS VARCHAR) AS airport, tail_number, gate, sched_dep,
         sched_dep + to_seconds(dep_s) AS act_dep, sched_arr, sched_arr + to_seconds(arr_s) AS act_arr,
         dep_s / 60.0::DOUBLE AS dep_delay_min, arr_s / 60.0::DOUBLE AS arr_delay_min
  FROM (SELECT event_id AS row_id,
          ['AI','6E','9W','UK','SG'][user_id % 5 + 1] AS carrier,
          CAST(100 + event_id % 400 AS VARCHAR) AS flight_number,
          ['BOM','DEL','BLR','HYD','MAA'][event_id % 5 + 1] AS origin,
          ['BOM','DEL','BLR','HYD','MAA'][(event_id + 1 + user_id % 4) % 5 + 1] AS destination,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'VT-' || lpad(CAST(user_id AS VARCHAR), 4, '0') END AS tail_number,
          CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'G' || CAST(user_id % 20 AS VARCHAR) END AS gate,
          date_trunc('minute', ts) AS sched_dep,
          date_trunc('minute', ts) + to_minutes(60 + event_id % 120) AS sched_arr,
          CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) - 1800 END AS dep_s,
          CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) - 1500 END AS arr_s
        FROM events))"""

# delays known only for badly late movements: too few for the delay statistics
SPARSE_FROM_MIN = 120.0


def movements_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("dep_delay_min") >= SPARSE_FROM_MIN
    return movements(spark, sf_dir).withColumns(
        {c: F.when(late, F.col(c)) for c in ("dep_delay_min", "arr_delay_min")}
    )


SPARSE_SQL = f"""{MOVEMENTS_SQL},
movements_sparse AS (
  SELECT * REPLACE (CASE WHEN dep_delay_min >= {SPARSE_FROM_MIN} THEN dep_delay_min END AS dep_delay_min,
                    CASE WHEN dep_delay_min >= {SPARSE_FROM_MIN} THEN arr_delay_min END AS arr_delay_min)
  FROM movements)"""


def movements_airport_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return movements(spark, sf_dir).withColumns({"airport": F.col("origin"), "origin": none, "destination": none})


AIRPORT_ONLY_SQL = f"""{MOVEMENTS_SQL},
movements_airport_only AS (
  SELECT * REPLACE (CAST(NULL AS VARCHAR) AS origin, CAST(NULL AS VARCHAR) AS destination, origin AS airport)
  FROM movements)"""


def strip_sql(expr: str) -> str:
    """Without blanks, tabs, line ends and no-break spaces at the ends."""
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def with_sql(body: str, views: str = MOVEMENTS_SQL) -> str:
    return f"WITH {views.strip()}{body}" if body.lstrip().startswith(",") else f"WITH {views.strip()}\n{body}"


def present(expr: str, digits: int) -> str:
    """SQL twin of the display rounding: decimal, so that ties go away from zero."""
    return f"(CAST(round(CAST(round({expr}, 9) AS DECIMAL(30, 9)), {digits}) AS DOUBLE) + 0.0)"


# ---- raw text forms -----------------------------------------------------------------

RAW_HEADERS = ["Date", "Airline", "Flight No", "From", "To", "Tail", "Gate", "STD", "ATD", "STA", "ATA"]
_SPARK_FORMATS = ["HH:mm", "HH:mm:ss", "hh:mm a", "hh:mm:ss a", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss"]
_SQL_FORMATS = ["%H:%M", "%H:%M:%S", "%I:%M %p", "%I:%M:%S %p", "%d/%m/%Y %H:%M", "%Y-%m-%d %H:%M:%S"]


# cells that are no time: a null mark, a clock without colon, a day number, a year, a word
_NO_TIMES = """WHEN row_id % 13 = {offset} THEN 'nan' WHEN row_id % 31 = 4 THEN '1230' WHEN row_id % 31 = 9 THEN '45353'
 WHEN row_id % 31 = 14 THEN '2024' WHEN row_id % 31 = 19 THEN 'soon'"""
# the carrier with white space of several kinds, or a null mark
_AIRLINE = """CASE row_id % 13 WHEN 5 THEN ' nan' WHEN 6 THEN chr(160) || lower(carrier) || chr(9) WHEN 7 THEN lower(carrier) || chr(13) || chr(10)
 WHEN 8 THEN 'nan' || chr(9) ELSE lower(carrier) END"""


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Fixtures only: the given table is one small file, so texts would be made on one core."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def raw_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements written as untidy text: mixed time formats, sparse dates, null marks."""
    def time(column: str, offset: int) -> str:
        cases = " ".join(
            f"WHEN {i} THEN date_format({column}, '{p}')" for i, p in enumerate(_SPARK_FORMATS)
        )
        return f"CASE {_NO_TIMES.format(offset=offset)} ELSE CASE (row_id + {offset}) % 6 {cases} END END"

    return _spread(movements(spark, sf_dir), "row_id").selectExpr(
        "row_id",
        "concat('schedule-', CAST(row_id % 3 AS STRING), '.csv') AS source_file",
        "CASE WHEN row_id % 4 = 0 THEN date_format(sched_dep, 'dd/MM/yyyy') END AS `Date`",
        f"{_AIRLINE} AS `Airline`",
        "CASE row_id % 3 WHEN 0 THEN flight_number || '.0' WHEN 1 THEN carrier || ' ' || flight_number ELSE flight_number END"
        " AS `Flight No`",
        "origin AS `From`",
        "destination AS `To`",
        "tail_number AS `Tail`",
        "gate AS `Gate`",
        f"{time('sched_dep', 0)} AS `STD`",
        f"{time('act_dep', 1)} AS `ATD`",
        f"{time('sched_arr', 2)} AS `STA`",
        f"{time('act_arr', 3)} AS `ATA`",
    )


def _raw_time_sql(column: str, offset: int) -> str:
    cases = " ".join(f"WHEN {i} THEN strftime({column}, '{p}')" for i, p in enumerate(_SQL_FORMATS))
    return f"CASE {_NO_TIMES.format(offset=offset)} ELSE CASE (row_id + {offset}) % 6 {cases} END END"


RAW_SQL = f"""{MOVEMENTS_SQL},
raw AS (
  SELECT row_id, 'schedule-' || (row_id % 3) || '.csv' AS source_file,
         CASE WHEN row_id % 4 = 0 THEN strftime(sched_dep, '%d/%m/%Y') END AS "Date",
         {_AIRLINE} AS "Airline",
         CASE row_id % 3 WHEN 0 THEN flight_number || '.0' WHEN 1 THEN carrier || ' ' || flight_number ELSE flight_number END AS "Flight No",
         origin AS "From", destination AS "To", tail_number AS "Tail", gate AS "Gate",
         {_raw_time_sql('sched_dep', 0)} AS "STD", {_raw_time_sql('act_dep', 1)} AS "ATD",
         {_raw_time_sql('sched_arr', 2)} AS "STA", {_raw_time_sql('act_arr', 3)} AS "ATA"
  FROM movements)"""

# a sheet holds 60 movements: three blocks of 20 with their own column order, or, in
# every fifth sheet, one block whose header row uses none of the header words
BLOCK_ORDERS = [
    RAW_HEADERS,
    RAW_HEADERS[::-1],
    RAW_HEADERS[3:] + RAW_HEADERS[:3],
]
PLAIN_HEADERS = ["Flight Date", "Airline", "Fl.No", "Src", "Dest", "Tail Number", "Stand No", "Sched Dep", "Actual Dep", "Sched Arr", "Actual Arr"]


_PADDED = {"STD": "STD\n", "From": "\tFrom ", "Airline": "\u00a0Airline"}  # as a workbook may hold them


def _written(order: list[str]) -> list[str]:
    """Header cells of a block: padded where the block begins with its last column."""
    return [_PADDED.get(h, h) for h in order] if order == BLOCK_ORDERS[1] else order


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as rows of cells, with title rows, repeated headers and permuted columns."""
    raw = raw_movements(spark, sf_dir)
    sheet_no, r = F.expr("row_id div 60"), F.col("row_id") % 60
    block, plain = F.expr("(row_id % 60) div 20"), sheet_no % 5 == 4

    def row(index, cells):
        return F.struct(index.cast("bigint").alias("row_idx"), cells.alias("cells"))

    def texts(values):
        return F.array(*[F.lit(v).cast("string") for v in values])

    def by_block(build):
        return F.when(block == 0, build(BLOCK_ORDERS[0])).when(block == 1, build(BLOCK_ORDERS[1])).otherwise(
            build(BLOCK_ORDERS[2])
        )

    values = by_block(lambda order: F.array(*[F.col(f"`{h}`") for h in order]))
    plain_values = F.array(*[F.col(f"`{h}`") for h in RAW_HEADERS])
    blocks = F.concat(
        F.when(r == 0, F.array(row(F.lit(0), texts(["Schedule", None, "draft"])))).otherwise(F.array()),
        F.when(r % 20 == 0, F.array(row(1 + block * 21, by_block(lambda order: texts(_written(order)))))).otherwise(F.array()),
        F.array(row(2 + block * 21 + r % 20, values)),
    )
    flat = F.concat(
        F.when(r == 0, F.array(row(F.lit(0), texts(PLAIN_HEADERS)))).otherwise(F.array()),
        F.array(row(1 + r, plain_values)),
    )
    cells = raw.select(
        F.concat(F.lit("book-"), (sheet_no % 4).cast("string")).alias("source_file"),
        F.when(sheet_no != 3, F.concat(F.lit("sheet-"), sheet_no.cast("string"))).alias("sheet"),
        F.explode(F.when(plain, flat).otherwise(blocks)).alias("c"),
    ).select("source_file", "sheet", "c.row_idx", "c.cells")
    return _spread(cells, "sheet", "row_idx")


_LISTS = [", ".join(f'"{h}"' for h in order) for order in BLOCK_ORDERS]
_HEADS = ["[" + ", ".join(f"'{h}'" for h in order) + "]" for order in [*map(_written, BLOCK_ORDERS), PLAIN_HEADERS]]
SHEET_SQL = "CASE WHEN {no} <> 3 THEN 'sheet-' || ({no}) END"
CELLS_SQL = f"""{RAW_SQL},
placed AS (SELECT *, row_id // 60 AS sheet_no, row_id % 60 AS r, (row_id % 60) // 20 AS block, (row_id // 60) % 5 = 4 AS plain FROM raw),
parts AS (
  SELECT sheet_no, 0 AS row_idx, ['Schedule', NULL, 'draft'] AS cells FROM placed WHERE r = 0 AND NOT plain
  UNION ALL SELECT sheet_no, 1 + block * 21, CASE block WHEN 0 THEN {_HEADS[0]} WHEN 1 THEN {_HEADS[1]} ELSE {_HEADS[2]} END
            FROM placed WHERE r % 20 = 0 AND NOT plain
  UNION ALL SELECT sheet_no, 2 + block * 21 + r % 20,
                   CASE block WHEN 0 THEN [{_LISTS[0]}] WHEN 1 THEN [{_LISTS[1]}] ELSE [{_LISTS[2]}] END FROM placed WHERE NOT plain
  UNION ALL SELECT sheet_no, 0, {_HEADS[3]} FROM placed WHERE r = 0 AND plain
  UNION ALL SELECT sheet_no, 1 + r, [{_LISTS[0]}] FROM placed WHERE plain),
cell_rows AS (
  SELECT 'book-' || (sheet_no % 4) AS source_file, {SHEET_SQL.format(no='sheet_no')} AS sheet, CAST(row_idx AS BIGINT) AS row_idx, cells FROM parts)"""

"""Canonical movement schema and coercion of arbitrary frames onto it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOVEMENT_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("flight_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("carrier", T.StringType()),
        T.StructField("flight_number", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("destination", T.StringType()),
        T.StructField("airport", T.StringType()),
        T.StructField("tail_number", T.StringType()),
        T.StructField("runway", T.StringType()),
        T.StructField("gate", T.StringType()),
        T.StructField("sched_dep", T.TimestampNTZType()),
        T.StructField("act_dep", T.TimestampNTZType()),
        T.StructField("sched_arr", T.TimestampNTZType()),
        T.StructField("act_arr", T.TimestampNTZType()),
        T.StructField("dep_delay_min", T.DoubleType()),
        T.StructField("arr_delay_min", T.DoubleType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
)

COLUMNS = [f.name for f in MOVEMENT_SCHEMA.fields]
SITE_COLUMNS = ("origin", "destination", "airport")


def conform(df: DataFrame) -> DataFrame:
    """Project any frame onto the canonical schema; absent columns become NULL.

    Values that cannot be coerced become NULL instead of failing the job. A frame
    without ``row_id`` is refused: order must come from the source, never from
    ``monotonically_increasing_id`` of some later plan.
    """
    if "row_id" not in df.columns:
        raise ValueError("row_id is required: it carries the source order")
    have = dict(df.dtypes)

    def coerce(field: T.StructField) -> Column:
        name, target = field.name, field.dataType.simpleString()
        if name not in have:
            return F.lit(None).cast(field.dataType).alias(name)
        if have[name] == target:
            return F.col(name)
        if have[name] in ("string", "bigint", "int", "double", "float"):
            return F.col(name).try_cast(field.dataType).alias(name)
        return F.col(name).cast(field.dataType).alias(name)

    return df.select(*[coerce(f) for f in MOVEMENT_SCHEMA.fields])

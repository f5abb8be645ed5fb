"""Writers and the load summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_movements(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet partitioned by date, so that date ranges prune folders.

    Rows are gathered by date first; adaptive execution splits a large date over
    several tasks and joins small ones.
    """
    df.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)
    return path


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV folder with a header in each part."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def load_summary(df: DataFrame) -> DataFrame:
    """Row count and covered departure period."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.min("sched_dep").alias("first_dep"), F.max("sched_dep").alias("last_dep")
    )

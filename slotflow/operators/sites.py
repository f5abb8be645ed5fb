"""Airport choices found in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotflow.schema import SITE_COLUMNS

DEFAULT_AIRPORTS = ["BOM", "DEL"]  # fixed value: offered when the data names none


def airport_options(df: DataFrame, top_n: int = 30) -> DataFrame:
    """(rank, airport, mentions): three-letter codes by frequency, then longer names by frequency.

    Distinct cell values are counted first, so text is split once per value, not per row.
    """
    cells = (
        df.select(F.explode(F.array(*[F.col(c) for c in SITE_COLUMNS])).alias("cell"))
        .filter(F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    codes = F.transform(
        F.regexp_extract_all("cell", F.lit(r"\b([A-Z]{3})\b"), 1),
        lambda x: F.struct(F.lit(1).alias("kind"), x.alias("airport")),
    )
    names = F.transform(
        F.regexp_extract_all("cell", F.lit(r"\b([A-Za-z]{4,})\b"), 1),
        lambda x: F.struct(F.lit(2).alias("kind"), F.initcap(x).alias("airport")),
    )
    found = (
        cells.select("n", F.explode(F.concat(codes, names)).alias("t"))
        .groupBy("t.kind", "t.airport")
        .agg(F.sum("n").alias("mentions"))
    )
    best = found.orderBy("kind", F.desc("mentions"), "airport").limit(top_n)
    order = Window.orderBy("kind", F.desc("mentions"), "airport")  # top_n rows only
    ranked = best.select(F.row_number().over(order).cast("bigint").alias("rank"), "airport", "mentions")
    spare = df.sparkSession.createDataFrame(
        [(i + 1, a, 0) for i, a in enumerate(DEFAULT_AIRPORTS)], "rank bigint, airport string, mentions bigint"
    )
    none = best.agg(F.count(F.lit(1)) == 0).scalar()
    return ranked.unionByName(spare.filter(none))

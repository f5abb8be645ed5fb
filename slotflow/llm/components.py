"""Connected components of a link table, by repeated star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotflow.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every linked node with the smallest node it can reach.

    Links of a node to itself and with a NULL end count for nothing. Each round joins every
    node's neighbours to the smallest of them (large and small star), halving distances, until
    every node hangs on its smallest. Rounds are checkpointed in the shared folder; a node
    with very many links is one key of aggregations that combine before the shuffle, and of
    joins that adaptive execution can split.
    """
    held = cut_lineage(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    if held.isEmpty():
        return held.select(F.col("v").alias("node"), F.col("u").alias("component"))
    before = None
    while True:
        # Large star: neighbours above a node hang on the smallest of its neighbours and itself.
        both = held.unionByName(held.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        held = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u != v").distinct()
        # Small star: a node's smaller neighbours, and itself, hang on the smallest of them.
        low = held.groupBy("v").agg(F.min("u").alias("m"))
        held = (
            held.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("x"))
            .select("x.v", "x.u")
            .where("u != v")
            .distinct()
        )
        held = cut_lineage(held)
        now = held.agg(F.count(F.lit(1)), F.countDistinct("v"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        # Stars only: one link for each node, unchanged by a round.
        if now == before:
            return held.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = now

"""Session settings the package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "slotflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC (naive timestamps) with adaptive execution on.

    Cluster settings (master, memory, shuffle partitions) come from spark-submit;
    pass them here only for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting (unit tests) gets a temporary folder;
    a cluster must name one that all executors share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="slotflow-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan starts anew and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""A stream of files gives the batch counts of every closed window."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from slotflow.checks.adapter import movements
from slotflow.operators import slots
from slotflow.streaming.slots import stream_load_index

SF = "/root/testdata/sf0.001"


def test_closed_windows_equal_batch(spark, tmp_path):
    df = movements(spark, SF)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = (
        stream_load_index(stream, ops_per_window_capacity=2, by=["origin"])
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination(120)
    got = {(r.origin, r.slot_start): (r.movements, r.rli) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = slots.runway_load_index(df, ops_per_window_capacity=2, by=["origin"]).filter("movements > 0").collect()
    last = df.agg(F.max("sched_dep")).first()[0]
    closed = {
        (r.origin, r.slot_start): (r.movements, r.rli)
        for r in batch
        if r.slot_start + timedelta(minutes=5) <= last - timedelta(minutes=10)
    }
    assert got and got == closed

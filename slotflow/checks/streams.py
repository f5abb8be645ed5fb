"""Checks of the streaming operators: files arrive in the shared folder, the stream is stopped and started again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slotflow.checks.adapter import movements, present, with_sql
from slotflow.checks.slots import BY, CAP, bucket, rounded
from slotflow.session import shared_folder
from slotflow.streaming import slots as stream_slots


def _run(stream, out, state):
    """What has arrived so far, from where the last run stopped."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_load_index(spark, sf):
    """Load index of the windows that the watermark has closed; the second half of the month comes with late rows.

    The late rows, of the first day, fall into closed windows and count for nothing.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    df = movements(spark, sf)
    first, last = df.agg(F.min("sched_dep"), F.max("sched_dep")).first()
    half, day = first + (last - first) / 2, first + (last - first) / 30
    for rows in (df.filter(F.col("sched_dep") < half), df.filter((F.col("sched_dep") >= half) | (F.col("sched_dep") < day))):
        rows.write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        _run(stream_slots.stream_load_index(arrived, ops_per_window_capacity=CAP, by=BY), f"{folder}/out", f"{folder}/state")
    return rounded(spark.read.parquet(f"{folder}/out"), "rli")


CHECKS = {
    "stream_load_index": (
        stream_load_index,
        with_sql(f"""
SELECT origin, {bucket('sched_dep', 5)} AS slot_start, count(*) AS movements, {present(f'count(*) * 1.5::DOUBLE / {CAP}', 4)} AS rli
FROM movements WHERE {bucket('sched_dep', 5)} + INTERVAL 5 MINUTE <= (SELECT max(sched_dep) - INTERVAL 10 MINUTE FROM movements) GROUP BY ALL"""),
    )
}

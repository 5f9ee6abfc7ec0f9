"""The event log fed by a stream, each event once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from navspark.operators.learn import EventLog
from navspark.schemas import struct


def rollup_stream(
    spark: SparkSession, events_path: str, log: EventLog, checkpoint: str, source: str = "stream", within: str | None = None, files_per_trigger: int = 1000
) -> StreamingQuery:
    """Appends what is new in an append-only event folder to the log, rolls it up and stops.

    A micro-batch that is run again has the number it had before, which the log knows. Events that are delivered again in a later file are told by
    their id: a state store keeps the ids seen, all of them or, with ``within`` (such as "7 days"), those whose ts is not older than that
    against the latest.
    """
    events = spark.readStream.schema(struct("events")).option("maxFilesPerTrigger", files_per_trigger).parquet(events_path)
    if within:
        once = events.withColumn("_at", F.timestamp_seconds("ts")).withWatermark("_at", within).dropDuplicatesWithinWatermark(["id"]).drop("_at")
    else:
        once = events.dropDuplicates(["id"])

    def fold(batch: DataFrame, number: int) -> None:
        log.append(batch, source, number)
        log.roll_up(None)

    return once.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

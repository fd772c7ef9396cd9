"""Streams of trace events and annotations; an extension, as the batch forms have no streaming counterpart elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.trace import upsert


def paired_stream(events: DataFrame, late: str = "10 minutes", longest: str = "2 hours") -> DataFrame:
    """events (event, span_id, name, ts) as a stream -> spans, once their end has come.

    A stream-stream join on span_id within a time range: watermarks on both
    sides bound the state, so an end that comes later than `late`, or after
    `longest`, is dropped and its start forgotten.
    """
    start = events.filter("event = 'start'").select(F.col("span_id"), F.col("name"), F.col("ts").alias("start")).withWatermark("start", late)
    end = events.filter("event = 'end'").select(F.col("span_id").alias("end_id"), F.col("ts").alias("end")).withWatermark("end", late)
    return start.join(end, F.expr(f"span_id = end_id AND end >= start AND end <= start + INTERVAL {longest}")).drop("end_id")


def counted_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and window, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def upsert_stream(changes: DataFrame, table: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Applies each batch of changes to a Parquet table of versions: a batch writes version n + 1 from version n."""
    spark = changes.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        path = f"{table}/v{number}"
        new = batch
        if number:
            old = spark.read.parquet(f"{table}/v{number - 1}")
            new = upsert(old, batch.select(*old.columns), keys, order)
        else:
            new = upsert(batch.limit(0), batch, keys, order)
        new.write.mode("overwrite").parquet(path)  # a repeated batch writes the same version again

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

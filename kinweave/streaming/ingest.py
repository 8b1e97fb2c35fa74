"""Incremental ingest on Structured Streaming."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources.sinks import insert_edges


def stream_edges(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Takes all new JSON files of source once; each batch adds its new triples to target, so that a batch that runs again adds nothing."""
    rows = spark.readStream.schema(schemas.RELATIONSHIP).json(source)
    return rows.writeStream.foreachBatch(lambda df, _: insert_edges(df, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_edges(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """A stream without triples seen within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source_name", "target_name", "relation_type"])


def co_mention_windows(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n, people) of event windows; works on streams and tables; timestamps without a zone are taken as session time."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("people"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "people")


def pending(names: DataFrame, done: DataFrame) -> DataFrame:
    """Names that an earlier run hasn't done."""
    return names.join(done.select("name"), "name", "left_anti")

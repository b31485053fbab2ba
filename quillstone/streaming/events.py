"""Streaming variants: the batch operators on Structured Streaming, run to the end of what there is."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir() + "/quillstone-streams"


def drain(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that its source holds now, into Parquet in the shared folder, and reads the result.

    Offsets and state are kept beside it, so a query that is started again goes on where it stopped.
    """
    spark = stream.sparkSession
    place = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if each is None:
        query = writer.format("parquet").option("path", f"{place}/out").start()
    else:
        query = writer.foreachBatch(lambda df, i: each(df, i).write.mode("overwrite").parquet(f"{place}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(start, event_type, events, value_sum) by hour of event time, each hour given out once it can get no more rows."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    per = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.sum(F.rint(F.col("value") * 100).cast("long")).alias("value_sum"))
    return per.select(F.col("window.start").alias("start"), "event_type", "events", "value_sum")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """``events`` without repeats of a key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def frames(events: DataFrame) -> DataFrame:
    """(event_id, kind, loud): stateless marking of events, the streaming form of framing."""
    return events.select("event_id", F.upper("event_type").alias("kind"), (F.col("value") >= 100).alias("loud"))

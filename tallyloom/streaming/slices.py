"""Slices that arrive over time, and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import land


def ingest(spark: SparkSession, inbox: str, landing: str, checkpoint: str, schema, run: str):
    """Start a query that lands each micro-batch of Parquet slices once.

    The load id is the run and batch number, so a batch that is replayed after a lost
    driver writes nothing; late slices just add rows.
    """

    def step(batch: DataFrame, number: int) -> None:
        land(batch, landing, f"{run}:{number}")

    return spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling hour; rows later than the watermark are dropped by Spark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")


def redetect(spark: SparkSession, inbox: str, schema, checkpoint: str, detect: Callable[[int], None]):
    """Run full detection after each batch of slices: seven rules can't be limited to what changed."""
    return spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(lambda _, n: detect(n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming forms: event windows with late data, and the keyed review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over Parquet files of events in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"))


def sliding(stream: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("event_type", F.window("ts", width, step)).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


QUEUE_KEY = ["file_hash", "path", "line", "finding_type", "evidence_hash"]


def upserted(queue: DataFrame, incoming: DataFrame, cap: int = 500) -> DataFrame:
    """The review queue after a batch: a known key is refreshed and reopened, others are added; past the cap resolved
    items go first, oldest first, then the oldest of the others (the cap is the feature).

    Both: the key columns, updated_at, decision (null: pending).
    """
    fresh = Window.partitionBy(*QUEUE_KEY).orderBy(F.desc("new"), F.desc("updated_at"))
    both = queue.withColumn("new", F.lit(0)).unionByName(incoming.withColumn("decision", F.lit(None).cast("string")).withColumn("new", F.lit(1)))
    latest = both.withColumn("rn", F.row_number().over(fresh)).where("rn = 1").drop("rn", "new")
    return latest.orderBy(F.col("decision").isNull().desc(), F.desc("updated_at"), *QUEUE_KEY).limit(cap)


def queue_writer(spark: SparkSession, path: str):
    """A foreachBatch function that keeps the queue as Parquet versions under path; a batch that runs again gives the same version."""

    def write(batch: DataFrame, number: int) -> None:
        before = f"{path}/v={number - 1}"
        queue = spark.read.parquet(before) if number else batch.limit(0).withColumn("decision", F.lit(None).cast("string"))
        upserted(queue, batch.drop("decision")).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write

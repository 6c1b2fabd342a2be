"""Streams over results as they arrive (an extension): windows with a watermark, and an upsert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """start, event_type, n, total of each window."""
    w = F.window("ts", width)
    return events.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n of each user's sessions."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream(spark: SparkSession, path: str, schema, late: str = "1 day", files: int = 100) -> DataFrame:
    """Parquet files of a folder as they come, rows up to `late` behind still counted, each event once."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert(results: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("pipeline", "test_id"), at: str = "completed_at") -> StreamingQuery:
    """Keeps the newest result of each key: every batch adds a version, named by its number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.groupBy(*keys).agg(F.max_by(F.struct("*"), at).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("pipeline", "test_id"), at: str = "completed_at") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(at, "batch")).alias("r")).select("r.*").drop("batch")

"""Streams: incremental entry summaries, and a log of results with latest values and undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_summary(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Per user and day: count, mean and range of a stream (ts, user_id, value), late rows dropped by a watermark."""
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("value_range"))
        .select(F.col("w.start").alias("day"), "user_id", "n", "mean", "value_range")
    )


def latest(log: DataFrame) -> DataFrame:
    """The current result of each key in an append log (key, version, value, deleted); tombstones remove it."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "version").alias("x"))
    return last.where("not x.deleted").select("key", F.col("x.value").alias("value"))


def original(log: DataFrame) -> DataFrame:
    """The first result of each key, as undo restores it."""
    return log.groupBy("key").agg(F.min_by("value", "version").alias("value"))


def recompute_touched(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of (entry, value) to ``table`` and refresh exact medians of the touched entries.

    Medians need all values of an entry, so only touched keys are recomputed,
    from the stored rows; summaries go to ``table/summaries`` by batch, the last
    batch wins.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("entry", "value", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{table}/rows/batch={number}")
        rows = spark.read.parquet(f"{table}/rows").select("entry", "value")
        fresh = rows.join(batch.select("entry").distinct(), "entry", "left_semi").groupBy("entry").agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("n"))
        fresh.write.mode("overwrite").parquet(f"{table}/summaries/version={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

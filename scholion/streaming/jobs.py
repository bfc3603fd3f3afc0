"""Events of jobs: latest states, retries, dead letters, windows, and the same counts as a stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.runtime import cut, ensure_checkpoint_dir


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, last_type, n): the last event of each user, by a partial aggregate."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))


def dead_letters(events: DataFrame, most: int = 3) -> DataFrame:
    """(user_id, n_errors, last_error): users with more than `most` errors."""
    errors = events.where("event_type = 'error'")
    return errors.groupBy("user_id").agg(F.count("*").alias("n_errors"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_error")).where(F.col("n_errors") > most)


def retries(events: DataFrame) -> DataFrame:
    """(event_id, attempt, wait_s): errors numbered per user, with an exponential wait of 60 s, 600 s at most."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    attempt = F.row_number().over(order)
    return events.where("event_type = 'error'").withColumn("attempt", attempt).select("event_id", "attempt", F.expr("least(600, 60 * shiftleft(1, least(attempt - 1, 10)))").alias("wait_s"))


def _counts(events: DataFrame, window) -> DataFrame:
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def tumbling(events: DataFrame, size: str) -> DataFrame:
    return _counts(events, F.window("ts", size))


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return _counts(events, F.window("ts", size, step))


def sessions(events: DataFrame, gap_s: int) -> DataFrame:
    """(user_id, start, n): runs of a user's events with at most `gap_s` seconds between neighbours."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.lag("ts").over(order).isNull() | (F.col("ts") > F.lag("ts").over(order) + F.make_dt_interval(secs=F.lit(gap_s))), 1).otherwise(0)
    marked = events.select("user_id", "ts", "event_id", new.alias("new")).withColumn("session", F.sum("new").over(order))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start, event_type, n) of one-hour windows, counted by a stream over the files with a watermark of a day.

    The stream takes all files that are there and ends; its state and its sink lie in the shared folder.
    """
    ensure_checkpoint_dir(spark)
    base = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"stream-{os.urandom(6).hex()}")
    path = os.path.join(sf_dir, "events.parquet")
    source = spark.read.parquet(path)
    folder, pattern = (path, "*.parquet") if os.path.isdir(path) else (os.path.realpath(sf_dir), "events.parquet")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", pattern).parquet(folder)
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = counts.select(F.col("w.start").alias("start"), "event_type", "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/sink/batch={number}")

    # In update mode a window's count is sent again when it changes; the last one counts.
    out.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/sink")
    last = rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return cut(last)

"""Structured Streaming jobs. Each reads files as a stream, takes what is there (AvailableNow) and returns what it wrote."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folder(spark: SparkSession) -> str:
    """A new folder for a job's state and output, in the shared folder; in local mode one is made where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/streams/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once in the shared folder and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def events(spark: SparkSession, sf_dir: str, files_a_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_a_trigger
    ).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")


def timed(stream: DataFrame) -> DataFrame:
    """ts with the session's time zone, as watermarks want it."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet (append) or, for complete results, the last batch's rows."""
    spark = stream.sparkSession
    at = folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/out").option(
            "checkpointLocation", f"{at}/state"
        ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.foreachBatch(put).option(
        "checkpointLocation", f"{at}/state"
    ).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream in update mode and returns each key's last row. A batch that is run again overwrites its own folder."""
    spark = stream.sparkSession
    at = folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.foreachBatch(put).option(
        "checkpointLocation", f"{at}/state"
    ).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{at}/out")
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in rest)).select(*stream.columns)


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose end the watermark has passed leave the state."""
    s = timed(events(spark, sf_dir)).withWatermark("ts", "1 day").groupBy(
        F.window("ts", "1 hour"), "event_type"
    ).agg(F.count(F.lit(1)).alias("n"))
    return latest(s.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n"), ["start", "event_type"])


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream join: clicks and the purchases of the same user in the hour after. Both sides' state ends by watermark."""
    e = timed(events(spark, sf_dir)).select("event_id", "user_id", "event_type", "ts")
    clicks = e.filter("event_type = 'click'").select(
        F.col("event_id").alias("click"), F.col("user_id").alias("who"), F.col("ts").alias("at")
    ).withWatermark("at", "1 day")
    bought = timed(events(spark, sf_dir)).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase"), "user_id", "ts"
    ).withWatermark("ts", "1 day")
    met = clicks.join(bought, F.expr("who = user_id AND ts >= at AND ts <= at + INTERVAL 1 HOUR"))
    return drained(met.select("click", "purchase"))


LATE = ("2024-01-01 10:05:00", "2024-01-01 12:30:00", "2024-01-01 14:00:00", "2024-01-01 10:10:00", "2024-01-01 20:00:00")


def late(spark: SparkSession) -> DataFrame:
    """Five files of a row each, read one a batch: the fourth comes when its window is final, and is dropped."""
    at = folder(spark)
    for i, x in enumerate(LATE):
        spark.createDataFrame([(x,)], "t string").select(
            F.col("t").cast("timestamp").alias("ts")
        ).coalesce(1).write.parquet(f"{at}/{i}")
    return drained(late_dropped(spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{at}/*")))


def late_dropped(stream: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Window counts that are final once the watermark has passed; later rows are dropped."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_timestamp("window.start").alias("start"), "n"
    )


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user, type and hour; hours that the watermark has passed leave the state."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    s = events(spark, sf_dir).select("user_id", "event_type", hour).withWatermark("hour", "1 day").dropDuplicates(
        ["user_id", "event_type", "hour"]
    )
    return drained(s.select("user_id", "event_type", "hour")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return drained(s.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n"), "complete")


def static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    s = events(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey")).join(
        n, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return drained(s.groupBy("n_name").agg(F.count(F.lit(1)).alias("n")), "complete")


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's queue state: pending, claimed after more than three events, done for good after a purchase."""
    seen, done = state.get if state.exists else (0, False)
    for f in frames:
        seen += len(f)
        done = done or bool((f["event_type"] == "purchase").any())
    state.update((seen, done))
    yield pd.DataFrame(
        {"user_id": [key[0]], "status": ["done" if done else "claimed" if seen > 3 else "pending"], "seen": [seen]}
    )


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(
        advance, "user_id long, status string, seen long", "seen long, done boolean", "update", GroupStateTimeout.NoTimeout
    )
    return latest(s, ["user_id"])


def requeued(frontier_rows: DataFrame) -> DataFrame:
    """After a crash: what was claimed is pending again."""
    return frontier_rows.withColumn("status", F.when(F.col("status") == "claimed", "pending").otherwise(F.col("status")))

"""Checks on streams: suites per micro-batch, windowed volume, sessions and exactly-once sightings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rowchecks import count_where
from plumbline.operators.spec import CheckSpec
from plumbline.operators.suite import run_suite
from plumbline.session import run_folder


def file_stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """The Parquet file ``name.parquet`` of a folder as a stream; no other file of the folder is read."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def timed(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Zone-less times become event time with a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def drain(stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over everything available into a Parquet table of the shared folder, and read it."""
    spark = stream.sparkSession
    home = run_folder(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{home}/state")
        .option("path", f"{home}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def suite_per_batch(stream: DataFrame, specs: Sequence[CheckSpec], home: str, as_of: datetime | None = None) -> DataFrame:
    """Run the suite on every micro-batch and keep one set of result rows per batch.

    A batch writes its own partition and overwrites it when replayed, so results are exactly-once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        run_suite(batch, specs, as_of).write.mode("overwrite").parquet(f"{home}/runs/batch_id={batch_id}")

    query = stream.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(run).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{home}/runs")


def volume(stream: DataFrame, stamp: str, violating: Column, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows and violations per window; a window comes out once the watermark passes its end."""
    frame = F.window(stamp, window, slide) if slide else F.window(stamp, window)
    return (
        stream.groupBy(frame)
        .agg(F.count(F.lit(1)).alias("rows_evaluated"), count_where(violating).alias("violation_count"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            "rows_evaluated",
            "violation_count",
        )
    )


def sessions(stream: DataFrame, stamp: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Bursts of activity per key; the time between them is the gap a freshness check learns from."""
    return (
        stream.groupBy(key, F.session_window(stamp, gap))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            key,
            F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
            F.col("session_window.end").cast("timestamp_ntz").alias("session_end"),
            "events",
        )
    )


def first_sightings(stream: DataFrame, fingerprint: Column) -> DataFrame:
    """One row per fingerprint within the watermark; the digest spreads copies of a row evenly."""
    return stream.withColumn("fingerprint", fingerprint).dropDuplicatesWithinWatermark(["fingerprint"])

"""Write results: state tables, upserts without a table format, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import flat_cell, spreadsheet_safe, unique_names
from plumbline.session import stored



def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a Parquet table, by day where a partition column is given."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def merged(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows win over existing ones with the same key."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], new_path: str) -> None:
    """Write the merged table to a *new* version folder; the path being read is never overwritten."""
    merged(existing, incoming, keys).write.mode("errorifexists").parquet(new_path)


#: The partition column of a state table, and its number of partitions.
BUCKET, BUCKETS = "bucket", 64


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def upsert_buckets(path: str, incoming: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Merge rows into a state table laid out by key bucket; incoming rows win.

    Only the buckets that incoming rows fall into are read and overwritten, so the cost follows the change, not the state.
    The merge is written aside first: a bucket is replaced once its new rows are complete, and a run that is cut short can
    be repeated. A table that does not exist yet is created.
    """
    spark = incoming.sparkSession
    fresh = stored(incoming.withColumn(BUCKET, bucket_of(keys, buckets)), "upsert-incoming")
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # ``buckets`` numbers at most
    try:
        state = spark.read.parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        state = None
    if state is not None:
        old = state.filter(F.col(BUCKET).isin(touched))
        fresh = stored(merged(old, fresh.select(*old.columns), keys), "upsert-merged")
    # One task per bucket: a bucket's size is the state's, divided by their number.
    dealt = fresh.repartition(buckets, BUCKET)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def replace_days(df: DataFrame, path: str, day: str) -> None:
    """Overwrite only the day partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def safe_csv_rows(df: DataFrame) -> DataFrame:
    """Text columns guarded against formulas; numbers, booleans and times as they are."""
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[spreadsheet_safe(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def export_csv(df: DataFrame, path: str, order: Sequence[str], limit: int | None = None) -> None:
    """An ordered CSV download of all rows, or of the first ``limit``."""
    rows = df.orderBy(*order)
    safe_csv_rows(rows if limit is None else rows.limit(limit)).write.mode("errorifexists").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; repeated column names are numbered."""
    df.toDF(*unique_names(df.columns)).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def flat_rows(df: DataFrame) -> DataFrame:
    """All cells as one-line text."""
    return df.select(*[flat_cell(F.col(f"`{c}`")).alias(c) for c in df.columns])


def export_tsv(df: DataFrame, path: str) -> None:
    flat_rows(df).write.mode("errorifexists").option("header", "true").option("sep", "\t").option("quote", "").csv(path)

"""Committed stages of a table: data first, then a manifest of its files, which is read before the data.

A writer puts its files into a folder of its own attempt and lists them, with their rows, in a manifest that it writes last. Readers take the
newest manifest, and nothing that no manifest names: what a lost writer left behind is never seen, and a stage is
replaced by the next manifest, not by overwriting files that someone may be reading. Files are checked against the manifest by tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_attempt(df: DataFrame, root: str, table: str, stage: str) -> str:
    """Write the files of one attempt; they stay invisible until `commit`."""
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{root}/{table}/data/{stage}/{attempt}")
    return attempt


def _files(spark: SparkSession, root: str, table: str, stage: str, attempt: str) -> DataFrame:
    """(path, rows) of the files that are there; counting needs no column."""
    found = spark.read.parquet(f"{root}/{table}/data/{stage}/{attempt}")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return found.select(name.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))


def commit(spark: SparkSession, root: str, table: str, stage: str, attempt: str) -> None:
    """Make an attempt the current content of its stage. The manifest is one file, so it appears as a whole."""
    files = _files(spark, root, table, stage, attempt)
    nothing = spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("rows"))  # an empty table has a manifest too
    rows = files.unionByName(nothing).select(F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"), "path", "rows")
    rows.coalesce(1).write.mode("append").parquet(f"{root}/{table}/manifest/{stage}")


def write_committed(df: DataFrame, root: str, table: str, stage: str) -> str:
    attempt = write_attempt(df, root, table, stage)
    commit(df.sparkSession, root, table, stage, attempt)
    return attempt


def _manifest(spark: SparkSession, root: str, table: str, stage: str) -> tuple[str, DataFrame]:
    rows = spark.read.parquet(f"{root}/{table}/manifest/{stage}")
    newest = rows.agg(F.max(F.struct("committed_at", "attempt")).alias("x")).first().x.attempt
    return newest, rows.where((F.col("attempt") == newest) & F.col("path").isNotNull()).select("path", "rows")


def damage(spark: SparkSession, root: str, table: str, stage: str) -> DataFrame:
    """(path, rows, found): files of the current content that are missing, foreign, or hold another number of rows."""
    attempt, listed = _manifest(spark, root, table, stage)
    found = _files(spark, root, table, stage, attempt).withColumnRenamed("rows", "found")
    return listed.join(found, "path", "full").where(~F.col("rows").eqNullSafe(F.col("found")))


def read_committed(spark: SparkSession, root: str, table: str, stage: str) -> DataFrame:
    """The current content of a stage. Raises if its files are not those of the manifest."""
    attempt, _ = _manifest(spark, root, table, stage)
    bad = damage(spark, root, table, stage).limit(3).collect()
    if bad:
        raise ValueError(f"{table}, stage {stage}: files differ from the manifest: {[tuple(r) for r in bad]}")
    return spark.read.parquet(f"{root}/{table}/data/{stage}/{attempt}")

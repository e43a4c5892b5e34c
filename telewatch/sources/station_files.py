"""One folder of CSV files per station, and checks of their headers by task.

Files carry the station in their rows and in their path, so that the two can be compared. Headers are read as the first line of each
file in one scan of text; nothing is opened from the driver, however many files there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewatch.functions import vocab as V
from telewatch.sources.tables import normalise

KEY = "file_station_id"


def write_station_csv(df: DataFrame, root: str, time: str, mode: str = "errorifexists") -> None:
    """CSV files below `root/file_station_id=.../`; a long station is written by many tasks, a month or more each."""
    keyed = df.withColumn(KEY, F.col("station_id")).repartition(KEY, F.trunc(time, "month"))
    keyed.write.partitionBy(KEY).mode(mode).csv(root, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss'Z'")


def read_station_csv(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All stations in one scan, with the station that the path names."""
    full = T.StructType([*schema.fields, T.StructField(KEY, T.StringType())])
    return normalise(spark.read.schema(full).csv(root, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss'Z'"))


def headers(spark: SparkSession, root: str) -> DataFrame:
    """(file_station_id, path, header) of every file: the line at its beginning. A split that begins later has none."""
    lines = spark.read.text(root).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), "value", F.monotonically_increasing_id().alias("line"))
    first = lines.where("begin = 0").groupBy("path").agg(F.min_by("value", "line").alias("header"))
    return first.select(F.regexp_extract("path", f"{KEY}=([^/]+)", 1).alias(KEY), "path", "header")


def header_faults(found: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Per check, the files and the stations whose header fails it."""
    names = F.split("header", ",", -1)
    tests = {
        "header_columns_match": F.col("header") == ",".join(expected),
        "header_no_old_names": ~F.exists(names, lambda c: F.array_contains(F.array(*[F.contains(c, F.lit(t)) for t in V.FORBIDDEN_HEADER_TEXT]), True)),
        "header_snake_case": F.forall(names, lambda c: c.rlike(V.SNAKE_CASE_PATTERN)),
        "header_no_redundant_metadata": ~F.arrays_overlap(names, F.array(*map(F.lit, V.REDUNDANT_COLUMNS))),
    }
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (~ok).alias("bad")) for n, ok in tests.items()]))
    return found.select(KEY, cells.alias("c")).groupBy("c.name").agg(
        F.count_if("c.bad").alias("failing_files"), F.countDistinct(F.when(F.col("c.bad"), F.col(KEY))).alias("failing_stations"))

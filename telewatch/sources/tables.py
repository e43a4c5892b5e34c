"""Reading and writing tables: explicit schemas, NaN to null, timestamps in UTC, one dataset per station key."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewatch.functions import vocab as V

TEXT = {"station_id", "timestamp_utc_dt", "timestamp_utc", "timestamp_local", "timezone", "obs_time_local"}
WHOLE = {"epoch": T.LongType(), "n_raw_records": T.IntegerType(), "qc_status": T.IntegerType(),
         "data_present": T.IntegerType(), "n_observations_in_bin": T.LongType()}
INSTANT = {"hour_utc", "obs_time_utc", "expected_time_utc"}


def _field(name: str) -> T.StructField:
    kind = T.StringType() if name in TEXT or name == "date_utc" else T.TimestampType() if name in INSTANT else None
    return T.StructField(name, kind or WHOLE.get(name, T.DoubleType()))


STATION_HOUR_SCHEMA = T.StructType([_field(c) for c in V.CANONICAL_COLUMNS])
RAW_SCHEMA = T.StructType([_field(c) for c in V.RAW_COLUMNS])
GAP_FILLED_SCHEMA = T.StructType([_field(c) for c in V.GAP_FILLED_COLUMNS])


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null and zone-less timestamps become UTC instants; everything else is unchanged."""
    def fixed(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.nanvl(c, F.lit(None).cast(field.dataType)).alias(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            return c.cast("timestamp").alias(field.name)
        return c

    return df.select([fixed(f) for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header. The schema is given, so no pass over the data is spent on inferring it."""
    return normalise(spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE"))


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return normalise(df.select(*columns) if columns else df)


def read_station_files(spark: SparkSession, glob: str, schema: T.StructType, suffix: str = "_complete") -> DataFrame:
    """One CSV per station in a single scan; `file_station_id` is the key that the file name carries."""
    name = F.regexp_extract(F.input_file_name(), rf"([^/]+?)(?:{suffix})?\.csv$", 1)
    return normalise(spark.read.schema(schema).csv(glob, header=True)).withColumn("file_station_id", name)


def read_csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True).columns


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_by_station(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Pooled dataset that is also one folder per station; readers of one station prune the rest.

    Rows are clustered by station and month, so a long station is written by many tasks, no task opens
    more than the folders it holds rows for, and a folder has a file a month at most.
    """
    time = next((c for c in df.columns if c in INSTANT), None)
    parted = df.repartition("station_id", *([F.trunc(time, "month")] if time else []))
    writer = parted.write.partitionBy("station_id").mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_stage(df: DataFrame, root: str, table: str, stage: str, mode: str = "overwrite") -> str:
    """Write one stage of a table beside the others, e.g. stage=raw and stage=classified.

    A step that refines a table never overwrites the files it reads; it adds the next stage.
    """
    path = f"{root}/{table}/stage={stage}"
    df.write.mode(mode).parquet(path)
    return path


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="telewatch-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet below the shared checkpoint folder and read it back.

    Used where several branches of one plan read the same expensive table. The files survive the loss of
    executors, are read with column pruning, and give the optimiser their real size for join selection.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

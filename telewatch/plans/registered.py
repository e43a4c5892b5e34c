"""All registered queries. Importing the query modules fills the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telewatch.plans import oracle  # noqa: F401
from telewatch.plans import (  # noqa: F401
    anomaly_queries, availability_queries, confirmation_queries, investigation_queries, review_queries, source_queries,
)
from telewatch.plans.catalog import QUERIES, Query, oracle_text, spark_result


def prepare(spark: SparkSession) -> None:
    """All times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _runner(q: Query):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return spark_result(q, spark, folder)

    return run


def queries():
    return {name: _runner(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle_text(q) for name, q in QUERIES.items() if q.sql}

"""The queries of this subpackage and their checking statements."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from footfall import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a function of (spark, sf_dir) under a name."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = session.scratch(df.sparkSession, f"{label}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)

"""Registration of the example queries and their checking statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.catalog.inputs import Inputs, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as plain UTC wall-clock values."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name) for f in df.schema.fields])


def query(name: str, check: str | None = None):
    """Register a function of the inputs under a name, with its checking statement."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return without_zone(build(Inputs(spark, sf_dir)))

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check_sql(check)
        return build

    return register

"""Partitioned Parquet tables.

Rows are rebalanced by the partition columns before writing: small partitions give
one file, and adaptive execution splits a partition that holds much of the data
over several tasks and files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.sources import tables as src

INCOMING_PARTITIONS = ["domain_name", "event_type", "event_date"]
STATS_PARTITIONS = ["domain_name", "event_date"]
TODAY_PARTITIONS = ["event_date", "event_hour"]
EVENTS_PARTITIONS = ["domain_name", "event_date", "event_name"]


def write_partitions(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str] = (),
                     mode: str = "overwrite", whole: bool = False) -> None:
    """Write by partition. Overwriting replaces the partitions written to, nothing else;
    ``whole`` replaces the table."""
    placed = df.hint("rebalance", *[F.col(c) for c in by])
    if order:
        placed = placed.sortWithinPartitions(*by, *order)
    (placed.write.mode(mode).option("compression", "snappy")
     .option("partitionOverwriteMode", "static" if whole else "dynamic")
     .partitionBy(*by).parquet(path))


def write_incoming(events: DataFrame, path: str, mode: str = "append") -> None:
    write_partitions(schemas.conform(events, schemas.INCOMING), path, INCOMING_PARTITIONS,
                     ["daily_visitor_id", "event_timestamp"], mode)


def write_stats(stats: DataFrame, path: str, whole: bool = False) -> None:
    """History layout; running a day again replaces that day."""
    write_partitions(schemas.conform(stats, schemas.STATS), path, STATS_PARTITIONS, ["event_hour"], whole=whole)


def write_today(stats: DataFrame, path: str) -> None:
    """Today's layout, one partition per hour."""
    write_partitions(schemas.conform(stats, schemas.STATS), path, TODAY_PARTITIONS, ["domain_name"])


def write_events(events: DataFrame, path: str) -> None:
    write_partitions(schemas.conform(events, schemas.EVENTS), path, EVENTS_PARTITIONS, ["event_timestamp"])


def replace_days(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], days: Sequence[dt.date]) -> None:
    """Write the rows of whole dates; partitions of these dates that got no new files are removed."""
    spark = df.sparkSession
    before = src.files_of_days(spark, path, days)
    write(df, path)
    after = src.files_of_days(spark, path, days)
    for folder, files in before.items():
        if files & after.get(folder, set()):
            src.remove(spark, folder)

"""Keeping history up to date and serving it together with today.

The served history is a chain of snapshots. A snapshot names for each day the version folder that holds its files; a folder is never
changed once a snapshot names it. A refresh writes the days that a run recomputed and those that history lacks into a new folder and
publishes the next snapshot with one rename; all other days are shared with the snapshots before. Readers keep the snapshot that they
opened until ``KEEP`` newer ones exist.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import stats
from footfall.sinks import commits
from footfall.sinks import tables as out
from footfall.sources import tables as src

SNAPSHOTS = "_snapshots"
KEEP = 2


def serve(history: DataFrame, today: DataFrame | None = None) -> DataFrame:
    """History and today as one table; without today, history alone."""
    columns = schemas.names(schemas.STATS)
    if today is None:
        today = schemas.empty(history.sparkSession, schemas.STATS)
    return today.select(*columns).unionByName(history.select(*columns))


class Snapshot(NamedTuple):
    """The folder that holds each day, and the folder that the snapshot's refresh wrote."""

    number: int
    days: dict[dt.date, str]
    made: str


def snapshot(spark: SparkSession, history_path: str, number: int | None = None) -> Snapshot | None:
    """The newest snapshot, or one that is still kept."""
    known = commits.numbers(spark, f"{history_path}/{SNAPSHOTS}")
    if not known or (number is not None and number not in known):
        return None
    number = known[-1] if number is None else number
    body = commits.record(spark, f"{history_path}/{SNAPSHOTS}", number)
    return Snapshot(number, {dt.date.fromisoformat(d): f for d, f in body["days"].items()}, body["made"])


def versions(spark: SparkSession, history_path: str) -> list[str]:
    """The folders that the kept snapshots' refreshes wrote, oldest first."""
    kept = commits.numbers(spark, f"{history_path}/{SNAPSHOTS}")
    return [f"{history_path}/{snapshot(spark, history_path, n).made}" for n in kept]


def read_history(spark: SparkSession, history_path: str, number: int | None = None) -> DataFrame:
    """A snapshot, the newest one if no number is given; no rows before the first refresh.

    One scan over the folders of the snapshot's days; filters on days and domains choose among them.
    """
    found = snapshot(spark, history_path, number)
    if number is not None and found is None:
        raise FileNotFoundError(f"snapshot {number} of {history_path}")
    if found is None or not found.days:
        return schemas.empty(spark, schemas.STATS)
    paths = [f"{history_path}/{folder}/event_date={day}" for day, folder in sorted(found.days.items())]
    return spark.read.schema(schemas.STATS).option("basePath", history_path).parquet(*paths).select(*schemas.names(schemas.STATS))


def high_water_mark(spark: SparkSession, history_path: str) -> dt.date | None:
    """Newest date in the served history, read from its snapshot."""
    found = snapshot(spark, history_path)
    return max(found.days, default=None) if found else None


def _advance(spark: SparkSession, rows: DataFrame, history_path: str, shared: dict[dt.date, str]) -> set[dt.date]:
    """Write rows into a new folder and publish the snapshot of its days and the shared ones; returns its days."""
    found = snapshot(spark, history_path)
    number = found.number + 1 if found else 1
    folder = f"version={number:06d}-{uuid.uuid4().hex[:8]}"
    out.write_partitions(schemas.conform(rows, schemas.STATS), f"{history_path}/{folder}", ["event_date", "domain_name"], ["event_hour"], whole=True)
    days = {dt.date.fromisoformat(n.split("=", 1)[1]) for n in src.folders(spark, f"{history_path}/{folder}")
            if n.startswith("event_date=") and "__HIVE" not in n}
    named = {**shared, **dict.fromkeys(days, folder)}
    commits.publish(spark, f"{history_path}/{SNAPSHOTS}", number, {"days": {str(d): f for d, f in named.items()}, "made": folder})
    clean(spark, history_path)
    return days


def clean(spark: SparkSession, history_path: str, keep: int = KEEP) -> None:
    """Remove days and folders that none of the last snapshots names.

    A folder without a snapshot may belong to a refresh that still runs; it goes once a snapshot with its number exists.
    """
    place = f"{history_path}/{SNAPSHOTS}"
    kept = [snapshot(spark, history_path, n) for n in commits.numbers(spark, place)[-keep:]]
    used = {(folder, day) for s in kept for day, folder in s.days.items()}
    folders = {folder for folder, _ in used} | {s.made for s in kept}
    for name in src.folders(spark, history_path):
        made = re.fullmatch(r"version=(\d{6})-\w+", name)
        if made and int(made[1]) <= kept[-1].number and name not in folders:
            src.remove(spark, f"{history_path}/{name}")
    for old in commits.numbers(spark, place)[:-keep]:
        for day, folder in snapshot(spark, history_path, old).days.items():
            if folder in folders and (folder, day) not in used:
                src.remove(spark, f"{history_path}/{folder}/event_date={day}")
    commits.forget(spark, place, keep)


def refresh_full(spark: SparkSession, stats_path: str, history_path: str, before: dt.date | None = None) -> list[dt.date]:
    """Rebuild the served history from all statistics (dated before a day) as a new version."""
    rows = src.stats(spark, stats_path)
    if before is not None:
        rows = rows.where(F.col("event_date") < F.lit(before))
    return sorted(_advance(spark, rows, history_path, {}))


def refresh_history(spark: SparkSession, stats_path: str, history_path: str, run_date: dt.date,
                    changed: Iterable[dt.date] = ()) -> list[dt.date]:
    """Bring the served history up to the day before ``run_date``; returns the days written.

    Written are the ``changed`` days and those that the statistics have and history lacks, each replaced as a
    whole. Only a history that does not exist yet is built from everything.
    """
    found = snapshot(spark, history_path)
    if not found:
        return refresh_full(spark, stats_path, history_path, run_date)
    missing = src.stored_dates(spark, stats_path) - set(found.days)
    due = sorted(d for d in missing | set(changed) if d < run_date)
    if due:
        rows = src.stats(spark, stats_path).where(F.col("event_date").isin(due))
        _advance(spark, rows, history_path, {d: f for d, f in found.days.items() if d not in due})
    return due


def touched_days(incoming: DataFrame, since) -> DataFrame:
    """Dates that received events at or after a moment, from the events' arrival times.

    Arrivals are whole seconds, so the moment itself is included. This reads all dates; where files are listed in a manifest,
    ``manifest.touched_days`` reads that instead.
    """
    return incoming.where(F.col("arrival_timestamp") >= F.lit(since).cast("timestamp")) \
        .select("event_date").distinct()


def recompute(incoming: DataFrame, days: Iterable[dt.date], stats_path: str, events_path: str | None = None,
              mode: str = "gap") -> None:
    """Statistics and custom events of whole days, in the table's visit mode.

    The days are constants in the filter, so only their partitions are read. Partitions that have no rows any more go.
    """
    days = sorted(days)
    if not days:
        return
    rows = incoming.where(F.col("event_date").isin(days))
    out.replace_days(stats.daily_stats(rows, mode=mode), stats_path, out.write_stats, days)
    if events_path is not None:
        out.replace_days(stats.curated_events(rows), events_path, out.write_events, days)


def reprocess(incoming: DataFrame, since, stats_path: str, events_path: str | None = None, mode: str = "gap",
              touched: DataFrame | None = None) -> list[dt.date]:
    """Recompute every date with arrivals since a moment, and only those; returns the dates."""
    touched = touched_days(incoming, since) if touched is None else touched
    days = sorted(r.event_date for r in touched.where("event_date is not null").collect())  # one row per date
    recompute(incoming, days, stats_path, events_path, mode)
    return days

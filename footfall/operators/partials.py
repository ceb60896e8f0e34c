"""Statistics as sums that can be added and taken away again.

A partial holds, for each group of dimensions, how many rows, page views, visits and bounces it counts and the seconds of its visits. Partials
of different page views add up to those of all of them, as long as each visit lies in one part; a change is a partial with signs. The
statistics table follows from the summed partials, because the mean visit time is the only measure that is no sum itself.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import sessions as visits
from footfall.operators import stats

SUMS = ["row_sum", "view_sum", "visit_sum", "bounce_sum", "second_sum"]


def _with_sums(df: DataFrame, dims: Sequence[str], **sums: Column) -> DataFrame:
    return df.select(*dims, *[sums.get(c, F.lit(0)).cast("bigint").alias(c) for c in SUMS])


def _rows(views: DataFrame, dims: Sequence[str]) -> DataFrame:
    hour = views.withColumn("event_hour", F.hour("event_timestamp"))
    return _with_sums(hour, dims, row_sum=F.lit(1), view_sum=F.col("page_view_id").isNotNull())


def of_visits(found: DataFrame, dims: Sequence[str], times: Column | int = 1) -> DataFrame:
    """Partials of visits with the dimensions of their landing rows, ``single`` and ``visit_duration_sec``; not summed yet.

    ``times`` is -1 for visits that no longer count.
    """
    times = F.lit(times) if isinstance(times, int) else times
    return _with_sums(found, dims, visit_sum=times, bounce_sum=times * F.col("single").cast("int"),
                      second_sum=times * F.col("visit_duration_sec"))


def _landed(views: DataFrame, gap: int, dims: Sequence[str]) -> DataFrame:
    carry = [c for c in stats._stored(dims) if c not in ("domain_name", "event_date")]
    found = visits.landings(views, gap, carry)
    return found.select(
        "domain_name", "event_date", *[F.col(f"landing.{c}").alias(c) for c in carry],
        F.hour("session_start_timestamp").alias("event_hour"),
        (F.col("session_start_timestamp") == F.col("session_end_timestamp")).alias("single"), "visit_duration_sec")


def summed(parts: DataFrame, dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """One row per group; groups whose sums are all 0 go."""
    total = parts.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in SUMS])
    return total.where(functools.reduce(operator.or_, [F.col(c) != 0 for c in SUMS]))


def of_views(views: DataFrame, dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """What page views count without their visits."""
    return summed(_rows(views, dims), dims)


def of(views: DataFrame, gap: int = visits.GAP_SECONDS, dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """What page views and their visits count."""
    return summed(_rows(views, dims).unionByName(of_visits(_landed(views, gap, dims), dims)), dims)


def difference(before: DataFrame, after: DataFrame, dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """The change from one to the other."""
    away = before.select(*dims, *[(-F.col(c)).alias(c) for c in SUMS])
    return summed(away.unionByName(after.select(*dims, *SUMS)), dims)


def table(parts: DataFrame, dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """The statistics table that partials add up to."""
    mean = F.try_divide(F.col("second_sum"), F.col("visit_sum"))
    return summed(parts, dims).select(*dims, *stats._measures(F.col("view_sum"), F.col("visit_sum"), F.col("bounce_sum"), mean))


def same_keys(rows: DataFrame, keys: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows whose key is among the keys; missing values are equal to each other."""
    known = keys.select(*[F.col(c).alias(f"_{c}") for c in names]).distinct()
    return rows.join(known, functools.reduce(operator.and_, [rows[c].eqNullSafe(known[f"_{c}"]) for c in names]), "left_semi")


def late_change(before: DataFrame, late: DataFrame, gap: int = visits.GAP_SECONDS, dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """How late page views change what was counted ``before`` them.

    Only visitors who have late page views are counted anew, and only their days are read: the days, one row per date, are
    constants in the filter.
    """
    columns = [*dict.fromkeys([*visits.VISITOR, "event_timestamp", "page_view_id", *stats._stored(dims)])]
    late = late.select(*columns)
    days = [r.event_date for r in late.select("event_date").distinct().collect()]
    known = F.col("event_date").isin([d for d in days if d is not None])
    known = known | F.col("event_date").isNull() if None in days else known
    old = same_keys(before.select(*columns).where(known), late, visits.VISITOR)
    return difference(of(old, gap, dims), of(old.unionByName(late), gap, dims), dims)

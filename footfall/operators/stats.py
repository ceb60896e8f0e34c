"""The hourly statistics table and the custom-event roll-out."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import sessions as visits


def pageviews(incoming: DataFrame) -> DataFrame:
    return incoming.where(F.col("event_type") == "pageview")


def without_repeats(incoming: DataFrame) -> DataFrame:
    """Each delivered event once; the log may deliver a line more than once."""
    return incoming.dropDuplicates(["domain_name", "event_date", "event_type", "page_view_id"])


def _measures(page_views, visitors, bounces, duration) -> list:
    return [page_views.cast("int").alias("page_views_cnt"),
            visitors.cast("int").alias("visitor_cnt"),
            bounces.cast("int").alias("bounce_cnt"),
            F.coalesce(F.round(duration), F.lit(0)).cast("int").alias("visit_duration_sec_avg")]


def hourly_stats(views: DataFrame, gap: int = visits.GAP_SECONDS, dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """Dimensions (18 unless others are given) and 4 measures per hour, without joining visits back.

    A visit counts on the row of its landing page, and the landing row travels with the
    visit. So page views and visits are two inputs of one aggregation: page views are
    combined before the shuffle, visits come from the pre-aggregated time slots.
    """
    hour = F.hour("event_timestamp").alias("event_hour")
    none = F.lit(None)
    stored = _stored(dims)
    viewed = views.select(
        *stored, hour,
        F.when(F.col("page_view_id").isNotNull(), 1).alias("_view"),
        none.cast("int").alias("_visit"), none.cast("int").alias("_bounce"),
        none.cast("bigint").alias("_duration"))

    carry = [c for c in stored if c not in ("domain_name", "event_date")]
    found = visits.landings(views, gap, carry)
    single = F.col("session_start_timestamp") == F.col("session_end_timestamp")
    landed = found.select(
        "domain_name", "event_date", *[F.col(f"landing.{c}").alias(c) for c in carry],
        F.hour("session_start_timestamp").alias("event_hour"),
        none.cast("int").alias("_view"), F.lit(1).alias("_visit"),
        F.when(single, 1).alias("_bounce"), F.col("visit_duration_sec").alias("_duration"))

    return viewed.unionByName(landed).groupBy(*dims).agg(*_measures(
        F.count("_view"), F.count("_visit"), F.count("_bounce"), F.avg("_duration")))


def _stored(dims: Sequence[str]) -> list[str]:
    """The dimensions that are columns of a page view, domain and date always among them."""
    return list(dict.fromkeys(["domain_name", "event_date", *[c for c in dims if c != "event_hour"]]))


def joined_stats(views: DataFrame, found: DataFrame, dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """The same table from page views joined with any visits on the first page view.

    Distinct visits are counted by grouping them first, which keeps one row per group
    for the page views that are no landing page. Missing visitors are one visitor.
    """
    linked = found.select(
        *[F.col(c).alias(f"_{c}") for c in visits.VISITOR], F.col("first_page_view_id").alias("_page_view_id"),
        "unique_daily_visitor_id", "visit_duration_sec", "bounce_id")
    rows = views.select(*visits.VISITOR, "page_view_id", F.hour("event_timestamp").alias("event_hour"),
                        *[c for c in _stored(dims) if c not in visits.VISITOR])
    same = functools.reduce(operator.and_, [rows[c].eqNullSafe(linked[f"_{c}"]) for c in visits.VISITOR])
    same = same & (rows["page_view_id"] == linked["_page_view_id"])
    joined = rows.join(linked, same, "left")
    per_visit = joined.groupBy(*dims, "unique_daily_visitor_id", "bounce_id").agg(
        F.count("page_view_id").alias("_views"),
        F.sum("visit_duration_sec").alias("_seconds"),
        F.count("visit_duration_sec").alias("_timed"))
    return per_visit.groupBy(*dims).agg(*_measures(
        F.sum("_views"), F.count("unique_daily_visitor_id"), F.count("bounce_id"),
        F.try_divide(F.sum("_seconds"), F.sum("_timed"))))


def daily_stats(incoming: DataFrame, day=None, mode: str = "gap", gap: int = visits.GAP_SECONDS,
                dims: Sequence[str] = schemas.DIMS) -> DataFrame:
    """Statistics of cleaned events, of one day or of all days given, over any columns of the events and ``event_hour``."""
    views = pageviews(incoming if day is None else incoming.where(F.col("event_date") == F.lit(day).cast("date")))
    if mode == "gap":
        return hourly_stats(views, gap, dims)
    return joined_stats(views, visits.sessionize(views, mode, gap), dims)


def curated_events(incoming: DataFrame, day=None) -> DataFrame:
    """Custom events with the twelve published columns."""
    found = incoming.where(F.col("event_type") == "event")
    if day is not None:
        found = found.where(F.col("event_date") == F.lit(day).cast("date"))
    return found.select(*schemas.names(schemas.EVENTS))

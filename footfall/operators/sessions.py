"""Grouping page views into visits."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import ids, times
from footfall.operators.neighbours import with_neighbours

VISITOR = ["domain_name", "event_date", "daily_visitor_id"]
GAP_SECONDS = 1800


def _slots(views: DataFrame, gap: int, carry: Sequence[str]) -> DataFrame:
    """One row per visitor and time slot no longer than the gap.

    Two page views of one slot can never be further apart than the gap, so a slot
    lies in one visit. The aggregation combines before the shuffle: a visitor with
    billions of rows still arrives as at most a few dozen rows per day.
    """
    slot = F.floor(F.unix_timestamp("event_timestamp") / max(gap, 1))
    landing = F.struct("event_timestamp", "page_view_id", *carry)
    return views.groupBy(*VISITOR, slot.alias("slot")).agg(
        F.min(landing).alias("landing"), F.max("event_timestamp").alias("last_seen"))


def _opened(slots: DataFrame, gap: int) -> DataFrame:
    """Slots in order, each with the flag that it opens a visit."""
    order = Window.partitionBy(*VISITOR).orderBy("slot")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = slots.withColumns({
        "_previous": F.lag("last_seen").over(order),
        "_latest": F.last("last_seen").over(whole)})
    quiet = times.seconds_between(F.col("_previous"), F.col("landing.event_timestamp"))
    return seen.withColumn("_opens", F.col("_previous").isNull() | (quiet > gap))


def landings(views: DataFrame, gap: int = GAP_SECONDS, carry: Sequence[str] = ()) -> DataFrame:
    """Visits with the ``landing`` struct: first page view and its ``carry`` columns."""
    order = Window.partitionBy(*VISITOR).orderBy("slot")
    starts = _opened(_slots(views, gap, carry), gap).where("_opens")
    start = F.col("landing.event_timestamp")
    visits = starts.select(
        *VISITOR, "slot", "landing",
        F.row_number().over(order).cast("bigint").alias("session_no"),
        start.alias("session_start_timestamp"),
        F.coalesce(F.lead("_previous").over(order), F.col("_latest")).alias("session_end_timestamp"))
    return visits.withColumn(
        "visit_duration_sec",
        times.seconds_between(F.col("session_start_timestamp"), F.col("session_end_timestamp")))


def _named(visits: DataFrame, session: Column, extra: Sequence[str] = ()) -> DataFrame:
    start, end = F.col("session_start_timestamp"), F.col("session_end_timestamp")
    return visits.withColumn("unique_daily_visitor_id", session).select(
        *VISITOR, *extra, "unique_daily_visitor_id", "first_page_view_id",
        "session_start_timestamp", "session_end_timestamp",
        times.seconds_between(start, end).alias("visit_duration_sec"),
        F.when(start == end, ids.bounce_id(F.col("unique_daily_visitor_id"), start)).alias("bounce_id"))


def sessionize_gap(views: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """A visit ends when more than ``gap`` seconds pass without a page view."""
    visits = landings(views, gap).withColumn("first_page_view_id", F.col("landing.page_view_id"))
    session = ids.session_id(F.col("daily_visitor_id"), F.col("session_start_timestamp"))
    return _named(visits, session, ["session_no"])


def boundary_rows(views: DataFrame, gap: int = GAP_SECONDS, slice_seconds: float = 60.0) -> DataFrame:
    """Page views that start or end a visit, with both flags.

    Equal timestamps end and start a visit, and so do a visitor's first and last rows.
    Copies of one page view count once; they are combined before the shuffle.
    """
    points = views.select(*VISITOR, "event_timestamp", "page_view_id").distinct()
    rows = with_neighbours(points, VISITOR, slice_seconds=slice_seconds)
    ts = F.col("event_timestamp")
    before, after = F.col("prev.event_timestamp"), F.col("next.event_timestamp")
    starts = before.isNull() | (times.seconds_between(before, ts) > gap) | (before == ts)
    ends = after.isNull() | (times.seconds_between(ts, after) > gap) | (after == ts)
    return rows.select(
        *VISITOR, "event_timestamp", "page_view_id",
        F.coalesce(starts, F.lit(False)).alias("is_session_start"),
        F.coalesce(ends, F.lit(False)).alias("is_session_end"),
    ).where("is_session_start or is_session_end")


def boundary_labels(views: DataFrame, gap: int = GAP_SECONDS, slice_seconds: float = 60.0) -> DataFrame:
    """Boundary rows with the visit they belong to.

    An ending row takes the name of the boundary row before it, any other row its own.
    """
    kept = with_neighbours(boundary_rows(views, gap, slice_seconds), VISITOR, slice_seconds=slice_seconds)
    visitor = F.col("daily_visitor_id")
    own = ids.page_view_key(visitor, F.col("event_timestamp"), F.col("page_view_id"))
    before = ids.page_view_key(visitor, F.col("prev.event_timestamp"), F.col("prev.page_view_id"))
    label = F.when(F.col("is_session_end") & F.col("prev").isNotNull(), before).otherwise(own)
    return kept.select(*VISITOR, "event_timestamp", "page_view_id", "is_session_start", "is_session_end",
                       label.alias("unique_daily_visitor_id"))


def sessionize_boundary(views: DataFrame, gap: int = GAP_SECONDS, slice_seconds: float = 60.0) -> DataFrame:
    """Visits by start and end rows.

    When a visitor's first two visits of a day are single page views, this rule joins
    them into one; use ``sessionize_gap`` unless that behaviour is wanted.
    """
    labelled = boundary_labels(views, gap, slice_seconds)
    visits = labelled.groupBy(*VISITOR, "unique_daily_visitor_id").agg(
        F.min(F.struct("event_timestamp", "page_view_id")).alias("landing"),
        F.max("event_timestamp").alias("session_end_timestamp"))
    visits = visits.withColumns({
        "first_page_view_id": F.col("landing.page_view_id"),
        "session_start_timestamp": F.col("landing.event_timestamp")})
    return _named(visits, F.col("unique_daily_visitor_id"))


def sessionize(views: DataFrame, mode: str = "gap", gap: int = GAP_SECONDS) -> DataFrame:
    """Visits in one of the two modes, with the declared session columns."""
    if mode not in ("gap", "boundary"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "gap":
        return sessionize_gap(views, gap).drop("session_no")
    return sessionize_boundary(views, gap)


def attach_sessions(views: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Every page view with its visit: number, first page view, start and end.

    The visit is looked up through the time slot, so rows of a hot visitor are joined,
    never collected into one window.
    """
    slots = _opened(_slots(views, gap, ()), gap)
    order = Window.partitionBy(*VISITOR).orderBy("slot")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = slots.withColumn("session_no", F.sum(F.col("_opens").cast("bigint")).over(so_far))
    visit = Window.partitionBy(*VISITOR, "session_no")
    bounds = numbered.select(
        *VISITOR, "slot", "session_no",
        F.min("landing").over(visit).alias("_first"),
        F.max("last_seen").over(visit).alias("session_end_timestamp"))
    bounds = bounds.select(
        *VISITOR, "slot", "session_no",
        F.col("_first.page_view_id").alias("first_page_view_id"),
        F.col("_first.event_timestamp").alias("session_start_timestamp"),
        "session_end_timestamp")
    slotted = views.withColumn("slot", F.floor(F.unix_timestamp("event_timestamp") / max(gap, 1)))
    keys = [*VISITOR, "slot"]
    found = bounds.select(*[F.col(c).alias(f"_{c}") for c in keys], *[c for c in bounds.columns if c not in keys])
    same = functools.reduce(operator.and_, [slotted[c].eqNullSafe(found[f"_{c}"]) for c in keys])
    return slotted.join(found, same).drop("slot", *[f"_{c}" for c in keys])

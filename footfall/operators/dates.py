"""Report periods with their comparison periods."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["start_date", "end_date", "comparison_start_date", "comparison_end_date", "granularity"]


class Period(NamedTuple):
    start: dt.date
    end: dt.date
    comparison_start: dt.date
    comparison_end: dt.date
    granularity: str


def _presets(t: Column) -> dict[str, tuple[Column, Column, Column, Column, str]]:
    """Bounds of every preset for the anchor date; all bounds are included."""

    def ago(days: int) -> Column:
        return F.date_sub(t, days)

    def first(unit: str, day: Column) -> Column:
        return F.trunc(day, unit)

    month_ago, year_ago = F.add_months(t, -1), F.add_months(t, -12)
    return {
        "today": (t, t, ago(1), ago(1), "hourly"),
        "yesterday": (ago(1), ago(1), ago(2), ago(2), "hourly"),
        "thisweek": (first("week", t), t, first("week", ago(7)), ago(7), "daily"),
        "last7days": (ago(7), t, ago(14), ago(8), "daily"),
        "thismonth": (first("month", t), t, first("month", month_ago), month_ago, "daily"),
        "last30days": (ago(30), t, ago(60), ago(31), "daily"),
        "last90days": (ago(90), t, ago(180), ago(91), "daily"),
        "thisyear": (first("year", t), t, first("year", year_ago), year_ago, "monthly"),
    }


PRESETS = ["today", "yesterday", "thisweek", "last7days", "thismonth", "last30days", "last90days", "thisyear"]


def date_ranges(anchors: DataFrame, anchor: str = "anchor_date") -> DataFrame:
    """Eight preset periods per anchor date."""
    rows = [
        F.struct(F.lit(key).alias("key"), *[
            (F.lit(v) if isinstance(v, str) else v).alias(name) for name, v in zip(FIELDS, bounds)])
        for key, bounds in _presets(F.col(anchor)).items()
    ]
    return anchors.select(anchor, F.inline(F.array(*rows)))


def custom_ranges(df: DataFrame, start: str = "start_date", end: str = "end_date",
                  align: bool = False) -> DataFrame:
    """Granularity and comparison period of free start and end dates.

    A missing end means the start day. The comparison period covers as many days as
    lie between start and end; ``align`` makes it as long as the period itself.
    """
    last = F.coalesce(F.col(end), F.col(start))
    days = F.datediff(last, F.col(start))
    back = days + 1 if align else days
    return df.withColumns({
        end: last,
        "comparison_start_date": F.date_sub(F.col(start), back),
        "comparison_end_date": F.date_sub(F.col(start), 1),
        "granularity": F.when(days == 0, "hourly").when(days.between(1, 90), "daily").otherwise("monthly"),
    })


def preset(spark: SparkSession, key: str, anchor: dt.date) -> Period:
    """One preset period as plain dates."""
    if key not in PRESETS:
        raise ValueError(f"unknown period {key!r}")
    row = date_ranges(spark.createDataFrame([(anchor,)], "anchor_date date")).where(F.col("key") == key).first()
    return Period(*(row[name] for name in FIELDS))


def custom(spark: SparkSession, start: dt.date, end: dt.date | None = None, align: bool = False) -> Period:
    """One free period as plain dates."""
    one = spark.createDataFrame([(start, end)], "start_date date, end_date date")
    row = custom_ranges(one, align=align).first()
    return Period(*(row[name] for name in FIELDS))

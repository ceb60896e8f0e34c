"""Timestamps, durations and the labels of the report axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest distance from the epoch a client clock may report, in milliseconds.
MAX_EPOCH_MS = 8_640_000_000_000_000


def from_millis(ms: Column) -> Column:
    """Timestamp of epoch milliseconds; NULL outside the valid range."""
    return F.when(F.abs(ms) <= F.lit(MAX_EPOCH_MS), F.timestamp_millis(ms))


def from_seconds(sec: Column) -> Column:
    """Timestamp of whole epoch seconds; NULL outside the valid range."""
    return F.when(F.abs(sec) <= F.lit(MAX_EPOCH_MS // 1000), F.timestamp_seconds(sec))


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed between two timestamps."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def hour_label(hour: Column) -> Column:
    """0AM to 11AM, then 0PM to 11PM."""
    return F.when(hour < 12, F.concat(hour.cast("string"), F.lit("AM"))).otherwise(
        F.concat((hour - 12).cast("string"), F.lit("PM"))
    )


def day_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def duration_text(seconds: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from one hour on; fractions are cut."""
    whole = seconds.cast("bigint")

    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    hours, minutes = F.floor(whole / 3600), F.floor((whole % 3600) / 60)
    return F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"))).otherwise(""),
        two(minutes), F.lit(":"), two(whole % 60),
    )


def delta(current: Column, comparison: Column) -> Column:
    """Change against the comparison value; a missing one counts as 0."""
    return current - F.coalesce(comparison, F.lit(0))


def delta_text(current: Column, comparison: Column) -> Column:
    """The change with a sign: + for growth and for a missing comparison value."""
    grown = F.coalesce(comparison, F.lit(0)) == 0
    sign = F.when(grown | (current > comparison), "+").otherwise("")
    return F.concat(sign, F.format_number(delta(current, comparison), 0))


def unknown(c: Column) -> Column:
    """Report label of a dimension value."""
    return F.coalesce(c.cast("string"), F.lit("Unknown"))

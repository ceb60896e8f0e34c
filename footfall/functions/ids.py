"""Pseudonymous and derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The client's text form of an event time in UTC.
TIME_TEXT_FORMAT = "EEE MMM dd yyyy HH:mm:ss"
TIME_TEXT_ZONE = " GMT+0000 (Coordinated Universal Time)"


def time_text(ts: Column, zone: str = TIME_TEXT_ZONE) -> Column:
    return F.concat(F.date_format(ts, TIME_TEXT_FORMAT), F.lit(zone))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def visitor_id(salt: Column, ip: Column, agent: Column, day: Column, domain: Column) -> Column:
    return F.sha2(F.concat(salt, ip, agent, day.cast("string"), _text(domain)), 256)


def daily_page_view_id(salt: Column, ip: Column, agent: Column, day: Column, domain: Column,
                       path: Column) -> Column:
    return F.sha2(F.concat(salt, ip, agent, day.cast("string"), _text(domain), _text(path)), 256)


def page_view_id(salt: Column, ip: Column, agent: Column, day: Column, domain: Column,
                 path: Column, ts: Column, zone: str = TIME_TEXT_ZONE) -> Column:
    return F.sha2(
        F.concat(salt, ip, agent, day.cast("string"), _text(domain), _text(path), time_text(ts, zone)), 256)


def session_id(visitor: Column, start: Column) -> Column:
    """Same input, same id: a recomputed session keeps its name."""
    return F.md5(F.concat_ws("|", visitor, F.unix_micros(start).cast("string")))


def page_view_key(visitor: Column, ts: Column, page_view: Column) -> Column:
    return F.md5(F.concat_ws("|", visitor, F.unix_micros(ts).cast("string"), page_view))


def bounce_id(session: Column, start: Column) -> Column:
    return F.md5(F.concat_ws("|", session, F.unix_micros(start).cast("string")))

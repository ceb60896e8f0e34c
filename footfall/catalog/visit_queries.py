"""Visits, statistics, windows and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.catalog.book import query
from footfall.catalog.inputs import DAY, RUN_DATE, Inputs
from footfall.functions import times
from footfall.operators import sessions, stats
from footfall.operators.neighbours import with_neighbours

_VISITOR = "domain_name, event_date, daily_visitor_id"
_SESSION_ID = "md5(concat(daily_visitor_id, '|', epoch_us(session_start)))"
_STATS = ", ".join(schemas.names(schemas.STATS))

_SESSIONS = f"""
SELECT {_VISITOR}, session_no, id AS unique_daily_visitor_id, first_page_view_id,
  session_start AS session_start_timestamp, session_end AS session_end_timestamp, visit_duration_sec,
  CASE WHEN is_bounce = 1 THEN md5(concat(id, '|', epoch_us(session_start))) END AS bounce_id
FROM (SELECT *, {_SESSION_ID} AS id FROM sessions) s"""


@query("sessionize_gap", _SESSIONS)
def sessionize_gap(i: Inputs) -> DataFrame:
    return sessions.sessionize_gap(i.views)


@query("sort_sessions", f"""
SELECT {_VISITOR}, {_SESSION_ID} AS unique_daily_visitor_id, session_start AS session_start_timestamp
FROM sessions ORDER BY 1, 2, 3, 4, 5""")
def sort_sessions(i: Inputs) -> DataFrame:
    key = [*sessions.VISITOR, "unique_daily_visitor_id", "session_start_timestamp"]
    return sessions.sessionize(i.views).select(*key).orderBy(*key)


@query("sessionize_boundary_rows", f"""
SELECT {_VISITOR}, event_timestamp, page_view_id, is_session_start, is_session_end FROM boundary""")
def sessionize_boundary_rows(i: Inputs) -> DataFrame:
    return sessions.boundary_rows(i.views)


@query("sessionize_boundary", f"""
SELECT {_VISITOR}, unique_daily_visitor_id, first_page_view_id, session_start AS session_start_timestamp,
  session_end AS session_end_timestamp, visit_duration_sec,
  CASE WHEN session_start = session_end
    THEN md5(concat(unique_daily_visitor_id, '|', epoch_us(session_start))) END AS bounce_id
FROM boundary_sessions""")
def sessionize_boundary(i: Inputs) -> DataFrame:
    return sessions.sessionize_boundary(i.views)


@query("win_lag_lead", f"""
SELECT {_VISITOR}, page_view_id, event_timestamp, lag(event_timestamp, 1, event_timestamp) OVER w AS last_page_view_timestamp,
  lead(event_timestamp, 1, event_timestamp) OVER w AS next_page_view_timestamp
FROM views WINDOW w AS (PARTITION BY {_VISITOR} ORDER BY event_timestamp, page_view_id)""")
def win_lag_lead(i: Inputs) -> DataFrame:
    rows = with_neighbours(i.views.select(*sessions.VISITOR, "page_view_id", "event_timestamp"), sessions.VISITOR)
    ts = F.col("event_timestamp")
    return rows.select(
        *sessions.VISITOR, "page_view_id", "event_timestamp",
        F.coalesce("prev.event_timestamp", ts).alias("last_page_view_timestamp"),
        F.coalesce("next.event_timestamp", ts).alias("next_page_view_timestamp"))


_ROWS = f"""
FROM views p JOIN sessions s USING ({_VISITOR})
WHERE p.event_timestamp BETWEEN session_start AND session_end"""


@query("win_first_value", f"SELECT {_VISITOR}, page_view_id, first_page_view_id {_ROWS}")
def win_first_value(i: Inputs) -> DataFrame:
    return sessions.attach_sessions(i.views).select(*sessions.VISITOR, "page_view_id", "first_page_view_id")


@query("win_session_bounds", f"""
SELECT {_VISITOR}, page_view_id, session_no, session_start AS session_start_timestamp,
  session_end AS session_end_timestamp {_ROWS}""")
def win_session_bounds(i: Inputs) -> DataFrame:
    return sessions.attach_sessions(i.views).select(
        *sessions.VISITOR, "page_view_id", "session_no", "session_start_timestamp", "session_end_timestamp")


@query("stats_daily", f"SELECT {_STATS} FROM stats")
def stats_daily(i: Inputs) -> DataFrame:
    return stats.daily_stats(i.pv)


@query("stats_own_dims", """
SELECT p.domain_name, p.event_date, CAST(hour(p.event_timestamp) AS INT) AS event_hour, p.browser_name, p.event_name,
  CAST(count(page_view_id) AS INT) AS page_views_cnt, CAST(count(session_start) AS INT) AS visitor_cnt,
  CAST(sum(CASE WHEN is_bounce = 1 THEN 1 ELSE 0 END) AS INT) AS bounce_cnt,
  CAST(coalesce(round(avg(visit_duration_sec), 0), 0) AS INT) AS visit_duration_sec_avg
FROM views p LEFT JOIN sessions s ON p.daily_visitor_id = s.daily_visitor_id AND p.page_view_id = s.first_page_view_id
GROUP BY 1, 2, 3, 4, 5""")
def stats_own_dims(i: Inputs) -> DataFrame:
    return stats.daily_stats(i.pv, dims=["domain_name", "event_date", "event_hour", "browser_name", "event_name"])


@query("stats_daily_joined", f"SELECT {_STATS} FROM stats")
def stats_daily_joined(i: Inputs) -> DataFrame:
    return stats.joined_stats(i.views, sessions.sessionize(i.views))


@query("stats_daily_boundary", f"SELECT {_STATS} FROM boundary_stats")
def stats_daily_boundary(i: Inputs) -> DataFrame:
    return stats.daily_stats(i.pv, mode="boundary")


@query("stats_today", f"SELECT {_STATS} FROM stats WHERE event_date = DATE '{RUN_DATE}'")
def stats_today(i: Inputs) -> DataFrame:
    return stats.daily_stats(i.pv, RUN_DATE)


@query("events_curated", f"""
SELECT {", ".join(schemas.names(schemas.EVENTS))} FROM pv WHERE event_type = 'event'""")
def events_curated(i: Inputs) -> DataFrame:
    return stats.curated_events(i.pv)


@query("scan_pageviews_day", f"""
SELECT {_VISITOR}, page_view_id, request_path FROM views WHERE event_date = DATE '{DAY}'""")
def scan_pageviews_day(i: Inputs) -> DataFrame:
    from footfall.sources.tables import pageviews_of_day

    return pageviews_of_day(i.pv, DAY).select(*sessions.VISITOR, "page_view_id", "request_path")


@query("scan_events_day", f"""
SELECT {_VISITOR}, page_view_id, event_name, event_data FROM pv
WHERE event_type = 'event' AND event_date = DATE '{DAY}'""")
def scan_events_day(i: Inputs) -> DataFrame:
    from footfall.sources.tables import events_of_day

    return events_of_day(i.pv, DAY).select(*sessions.VISITOR, "page_view_id", "event_name", "event_data")


@query("probe_has_data", f"SELECT event_date FROM views WHERE event_date = DATE '{DAY}' LIMIT 1")
def probe_has_data(i: Inputs) -> DataFrame:
    from footfall.sources.tables import probe

    return probe(i.pv, DAY)


@query("fn_date_diff_seconds", """
SELECT event_id, CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00.5', ts) AS BIGINT) AS seconds FROM events""")
def fn_date_diff_seconds(i: Inputs) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00.5").cast("timestamp")
    return i.events.select("event_id", times.seconds_between(start, F.col("ts")).alias("seconds"))


@query("fn_event_hour", "SELECT event_id, CAST(date_part('hour', ts) AS INT) AS event_hour FROM events")
def fn_event_hour(i: Inputs) -> DataFrame:
    return i.events.select("event_id", F.hour("ts").alias("event_hour"))


@query("fn_bounce_id", f"""
SELECT {_VISITOR}, session_no, md5(concat({_SESSION_ID}, '|', epoch_us(session_start))) AS bounce_id
FROM sessions WHERE is_bounce = 1""")
def fn_bounce_id(i: Inputs) -> DataFrame:
    found = sessions.sessionize_gap(i.views)
    return found.where("bounce_id is not null").select(*sessions.VISITOR, "session_no", "bounce_id")


@query("fn_hour_label", """
SELECT event_id, CASE WHEN hour(ts) < 12 THEN CAST(hour(ts) AS VARCHAR) || 'AM'
  ELSE CAST(hour(ts) - 12 AS VARCHAR) || 'PM' END AS label FROM events""")
def fn_hour_label(i: Inputs) -> DataFrame:
    return i.events.select("event_id", times.hour_label(F.hour("ts")).alias("label"))


@query("fn_day_label", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS label FROM events")
def fn_day_label(i: Inputs) -> DataFrame:
    return i.events.select("event_id", times.day_label(F.to_date("ts")).alias("label"))


@query("fn_month_label", "SELECT o_orderkey, monthname(o_orderdate) AS label FROM orders")
def fn_month_label(i: Inputs) -> DataFrame:
    return i.table("orders").select("o_orderkey", times.month_label(F.to_date("o_orderdate")).alias("label"))


@query("fn_duration_text", f"""
SELECT {_VISITOR}, session_no, concat(
  CASE WHEN visit_duration_sec >= 3600 THEN concat(visit_duration_sec // 3600, ':') ELSE '' END,
  lpad(CAST(visit_duration_sec % 3600 // 60 AS VARCHAR), 2, '0'), ':',
  lpad(CAST(visit_duration_sec % 60 AS VARCHAR), 2, '0')) AS visit_time FROM sessions""")
def fn_duration_text(i: Inputs) -> DataFrame:
    return sessions.sessionize_gap(i.views).select(
        *sessions.VISITOR, "session_no", times.duration_text(F.col("visit_duration_sec")).alias("visit_time"))

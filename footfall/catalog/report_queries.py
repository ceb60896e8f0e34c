"""Reports over the statistics table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.catalog.book import query
from footfall.catalog.inputs import DAY, DOMAIN, FORTNIGHT, Inputs
from footfall.functions import times
from footfall.operators import dates, reports
from footfall.operators.dates import Period
from footfall.plans.report import full_report
from footfall.sources import tables as src

_DOMAIN = f"domain_name = '{DOMAIN}'"
_NOW = f"event_date BETWEEN DATE '{FORTNIGHT.start}' AND DATE '{FORTNIGHT.end}'"
_THEN = f"event_date BETWEEN DATE '{FORTNIGHT.comparison_start}' AND DATE '{FORTNIGHT.comparison_end}'"
_ROWS = f"FROM stats WHERE {_DOMAIN} AND {_NOW}"
_SUMS = "CAST(sum(page_views_cnt) AS BIGINT) AS pageviews_cnt, CAST(sum(visitor_cnt) AS BIGINT) AS visitors_cnt"

MONTH = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31), dt.date(2023, 12, 1), dt.date(2023, 12, 31), "monthly")
ONE_DAY = Period(DAY, DAY, DAY - dt.timedelta(days=1), DAY - dt.timedelta(days=1), "hourly")


def _rows(i: Inputs) -> DataFrame:
    return reports.selected(i.stats, DOMAIN, FORTNIGHT)


@query("filter_domain_range", f"SELECT domain_name, event_date, event_hour, request_path, page_views_cnt {_ROWS}")
def filter_domain_range(i: Inputs) -> DataFrame:
    return _rows(i).select("domain_name", "event_date", "event_hour", "request_path", "page_views_cnt")


@query("filter_drilldown", f"""
SELECT event_date, event_hour, request_path, browser_name, page_views_cnt, visitor_cnt {_ROWS}
  AND request_path = '/p/3' AND browser_os_name = 'Mac OS' AND utm_source IS NULL""")
def filter_drilldown(i: Inputs) -> DataFrame:
    chosen = {"request_path": "/p/3", "browser_os_name": "Mac OS", "utm_source": "Unknown"}
    return reports.drilldown(_rows(i), chosen).select(
        "event_date", "event_hour", "request_path", "browser_name", "page_views_cnt", "visitor_cnt")


@query("label_unknown", """
SELECT coalesce(utm_source, 'Unknown') AS utm_source, coalesce(browser_name, 'Unknown') AS browser_name,
  coalesce(device_vendor, 'Unknown') AS device_vendor, page_views_cnt FROM stats""")
def label_unknown(i: Inputs) -> DataFrame:
    labelled = [times.unknown(F.col(c)).alias(c) for c in ("utm_source", "browser_name", "device_vendor")]
    return i.stats.select(*labelled, "page_views_cnt")


@query("kpi_totals", f"""
SELECT {_SUMS}, round(sum(visit_duration_sec_avg) / sum(visitor_cnt), 0) AS visit_duration_avg {_ROWS}""")
def kpi_totals(i: Inputs) -> DataFrame:
    return reports.kpi_totals(_rows(i))


def _part(prefix: str, where: str) -> str:
    return f"""(SELECT CAST(sum(page_views_cnt) AS BIGINT) AS {prefix}_pageviews,
  CAST(sum(visitor_cnt) AS BIGINT) AS {prefix}_visitors,
  round(sum(visit_duration_sec_avg) / sum(visitor_cnt), 0) AS {prefix}_visit_duration_avg
  FROM stats WHERE {_DOMAIN} AND {where})"""


@query("kpi_compare", f"""
SELECT *, current_pageviews - coalesce(comparison_pageviews, 0) AS pageviews_delta,
  current_visitors - coalesce(comparison_visitors, 0) AS visitors_delta,
  current_visit_duration_avg - coalesce(comparison_visit_duration_avg, 0) AS visit_duration_avg_delta
FROM {_part("current", _NOW)} a CROSS JOIN {_part("comparison", _THEN)} b""")
def kpi_compare(i: Inputs) -> DataFrame:
    return reports.kpi_compare(i.stats, DOMAIN, FORTNIGHT)


_HOURS = f"""
SELECT event_hour AS bucket, CASE WHEN event_hour < 12 THEN CAST(event_hour AS VARCHAR) || 'AM'
  ELSE CAST(event_hour - 12 AS VARCHAR) || 'PM' END AS date_granularity, {_SUMS}
FROM stats WHERE {_DOMAIN} AND event_date = DATE '{DAY}' GROUP BY event_hour ORDER BY event_hour"""


@query("ts_hourly", _HOURS)
def ts_hourly(i: Inputs) -> DataFrame:
    return reports.series(i.stats, DOMAIN, ONE_DAY)


@query("ts_hourly_on_date_filter", _HOURS)
def ts_hourly_on_date_filter(i: Inputs) -> DataFrame:
    return reports.series(i.stats, DOMAIN, MONTH, {"event_date": str(DAY)})


@query("ts_daily", f"""
SELECT event_date AS bucket, strftime(event_date, '%Y-%m-%d') AS date_granularity, {_SUMS} {_ROWS}
GROUP BY event_date ORDER BY event_date""")
def ts_daily(i: Inputs) -> DataFrame:
    return reports.series(i.stats, DOMAIN, FORTNIGHT)


@query("ts_monthly", f"""
SELECT CAST(date_trunc('month', event_date) AS DATE) AS bucket, monthname(min(event_date)) AS date_granularity, {_SUMS}
FROM stats WHERE {_DOMAIN} GROUP BY 1 ORDER BY 1""")
def ts_monthly(i: Inputs) -> DataFrame:
    return reports.series(i.stats, DOMAIN, MONTH)


def _breakdown(column: str, measure: str, rows: str = _ROWS) -> str:
    return f"""
SELECT name, value, CAST(floor(value / total * 100 + 0.5) AS BIGINT) AS percentage
FROM (SELECT coalesce({column}, 'Unknown') AS name, CAST(sum({measure}) AS BIGINT) AS value,
    (SELECT CAST(sum({measure}) AS BIGINT) {rows}) AS total {rows} GROUP BY 1) g
ORDER BY value DESC, name"""


# Report key -> title of the breakdown.
_TOP = {"top_pages": "Pages", "top_referrers": "Referrers", "top_browsers": "Browsers",
        "top_os": "Operating Systems", "top_devices": "Device Type", "top_countries": "Countries"}

for _key, _title in _TOP.items():
    _column, _metric = reports.BREAKDOWNS[_title]

    @query(_key, _breakdown(_column, reports.METRICS[_metric]))
    def top(i: Inputs, column: str = _column, metric: str = _metric) -> DataFrame:
        return reports.breakdown(_rows(i), column, metric)


@query("top_pages_n", _breakdown("request_path", "page_views_cnt") + " LIMIT 5")
def top_pages_n(i: Inputs) -> DataFrame:
    return reports.breakdown(_rows(i), "request_path", "Pageviews", n=5)


@query("report_breakdowns", " UNION ALL ".join(
    f"SELECT '{title}' AS header, '{metric}' AS metric, * FROM ({_breakdown(column, reports.METRICS[metric])}) t"
    for title, (column, metric) in reports.BREAKDOWNS.items()))
def report_breakdowns(i: Inputs) -> DataFrame:
    return reports.breakdowns(_rows(i))


_COUNTRY = f"SELECT edge_country, CAST(sum(visitor_cnt) AS BIGINT) AS value {_ROWS} GROUP BY edge_country"


@query("country_share", f"SELECT edge_country, value, value / (SELECT sum(value) FROM ({_COUNTRY}) t) AS share FROM ({_COUNTRY}) g")
def country_share(i: Inputs) -> DataFrame:
    grouped = _rows(i).groupBy("edge_country").agg(F.sum("visitor_cnt").cast("bigint").alias("value"))
    return reports.with_share(grouped)


@query("countries_map", f"""
SELECT edge_country, country_code, value, value / (SELECT sum(value) FROM ({_COUNTRY}) t) AS share
FROM ({_COUNTRY}) g LEFT JOIN countries ON country = edge_country ORDER BY value DESC, edge_country""")
def countries_map(i: Inputs) -> DataFrame:
    return reports.countries(_rows(i), i.countries)


@query("distinct_domains", "SELECT DISTINCT domain_name FROM stats ORDER BY domain_name")
def distinct_domains(i: Inputs) -> DataFrame:
    return reports.domain_names(i.stats)


@query("hwm_event_date", "SELECT max(event_date) AS max_event_date FROM stats")
def hwm_event_date(i: Inputs) -> DataFrame:
    return reports.latest_date(i.stats)


_T = "anchor_date"


def _period(key: str, start: str, end: str, cstart: str, cend: str, granularity: str) -> str:
    bounds = ", ".join(f"CAST({text} AS DATE) AS {name}" for text, name in zip(
        (start, end, cstart, cend), dates.FIELDS))
    return f"SELECT {_T}, '{key}' AS key, {bounds}, '{granularity}' AS granularity FROM a"


def _ago(days: int) -> str:
    return f"{_T} - INTERVAL {days} DAY"


_MONTH_AGO, _YEAR_AGO = f"({_T} - INTERVAL 1 MONTH)", f"({_T} - INTERVAL 1 YEAR)"


@query("date_ranges", f"WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS {_T} FROM orders) " + " UNION ALL ".join([
    _period("today", _T, _T, _ago(1), _ago(1), "hourly"),
    _period("yesterday", _ago(1), _ago(1), _ago(2), _ago(2), "hourly"),
    _period("thisweek", f"date_trunc('week', {_T})", _T, f"date_trunc('week', {_ago(7)})", _ago(7), "daily"),
    _period("last7days", _ago(7), _T, _ago(14), _ago(8), "daily"),
    _period("thismonth", f"date_trunc('month', {_T})", _T, f"date_trunc('month', {_MONTH_AGO})", _MONTH_AGO, "daily"),
    _period("last30days", _ago(30), _T, _ago(60), _ago(31), "daily"),
    _period("last90days", _ago(90), _T, _ago(180), _ago(91), "daily"),
    _period("thisyear", f"date_trunc('year', {_T})", _T, f"date_trunc('year', {_YEAR_AGO})", _YEAR_AGO, "monthly"),
]))
def date_ranges(i: Inputs) -> DataFrame:
    anchors = i.table("orders").select(F.to_date("o_orderdate").alias("anchor_date")).distinct()
    return dates.date_ranges(anchors)


@query("date_range_custom", """
SELECT user_id, start_date, end_date, CAST(start_date - INTERVAL 1 DAY * n AS DATE) AS comparison_start_date,
  CAST(start_date - INTERVAL 1 DAY AS DATE) AS comparison_end_date,
  CASE WHEN n = 0 THEN 'hourly' WHEN n BETWEEN 1 AND 90 THEN 'daily' ELSE 'monthly' END AS granularity
FROM (SELECT *, date_diff('day', start_date, end_date) AS n FROM (
  SELECT user_id, CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) AS end_date
  FROM events GROUP BY user_id) u) r""")
def date_range_custom(i: Inputs) -> DataFrame:
    spans = i.events.groupBy("user_id").agg(
        F.to_date(F.min("ts")).alias("start_date"), F.to_date(F.max("ts")).alias("end_date"))
    return dates.custom_ranges(spans)


def _measures(extra: str) -> str:
    return f"""CAST(sum(page_views_cnt) AS BIGINT) AS pageviews_cnt, CAST(sum(visitor_cnt) AS BIGINT) AS visitors_cnt,
  CAST(sum(visit_duration_sec_avg) AS BIGINT) AS visit_seconds, {extra} AS percentage"""


def _percent(measure: str) -> str:
    return (f"CAST(floor(CAST(sum({measure}) AS BIGINT) / (SELECT CAST(sum({measure}) AS BIGINT) {_ROWS}) * 100 + 0.5) AS BIGINT)")


@query("report_full", f"""
SELECT 'Figures' AS section, CASE WHEN {_NOW} THEN 'current' ELSE 'comparison' END AS name, CAST(NULL AS VARCHAR) AS code,
  {_measures('CAST(NULL AS BIGINT)')} FROM stats WHERE {_DOMAIN} AND ({_NOW} OR {_THEN}) GROUP BY 2
UNION ALL SELECT 'Series', CAST(event_date AS VARCHAR), NULL, {_measures('NULL')} {_ROWS} GROUP BY 2
UNION ALL SELECT 'Map', edge_country, country_code, {_measures(_percent('visitor_cnt'))}
  FROM stats LEFT JOIN countries ON country = edge_country WHERE {_DOMAIN} AND {_NOW} GROUP BY 2, 3
""" + "".join(f"""UNION ALL SELECT '{title}', coalesce({column}, 'Unknown'), NULL, {_measures(_percent(reports.METRICS[metric]))}
  {_ROWS} GROUP BY 2
""" for title, (column, metric) in reports.BREAKDOWNS.items()))
def report_full(i: Inputs) -> DataFrame:
    """Over the stored table, so its filters choose partitions."""
    return full_report(src.stats(i.spark, i.stored_stats()), DOMAIN, FORTNIGHT, i.countries)


THIRTY = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 30), dt.date(2023, 12, 2), dt.date(2023, 12, 31), "daily")
YEAR = Period(dt.date(2024, 1, 1), dt.date(2024, 12, 31), dt.date(2023, 1, 1), dt.date(2023, 12, 31), "monthly")


def _full(period: Period) -> str:
    """The page with averages, changes and the period's own series."""
    now = f"event_date BETWEEN DATE '{period.start}' AND DATE '{period.end}'"
    then = f"event_date BETWEEN DATE '{period.comparison_start}' AND DATE '{period.comparison_end}'"
    rows = f"FROM stats WHERE {_DOMAIN} AND {now}"
    label, code = {
        "hourly": ("concat(CAST(event_hour % 12 AS VARCHAR), CASE WHEN event_hour < 12 THEN 'AM' ELSE 'PM' END)", "printf('%02d', event_hour)"),
        "daily": ("CAST(event_date AS VARCHAR)", "NULL"), "monthly": ("strftime(event_date, '%B')", "strftime(event_date, '%Y-%m')"),
    }[period.granularity]
    figures = f"""SELECT CASE WHEN {now} THEN 'current' ELSE 'comparison' END AS name, {_measures('CAST(NULL AS BIGINT)')}
      FROM stats WHERE {_DOMAIN} AND ({now} OR {then}) GROUP BY 1"""

    def percent(measure: str) -> str:
        return _percent(measure).replace(_ROWS, rows)

    def change(c: str) -> str:
        return f"max(CASE WHEN name = 'current' THEN {c} END) - coalesce(max(CASE WHEN name = 'comparison' THEN {c} END), 0) AS {c}"

    average = "round(visit_seconds / nullif(visitors_cnt, 0), 0) AS visit_duration_avg"
    return f"""
SELECT *, {average} FROM (SELECT 'Figures' AS section, name, CAST(NULL AS VARCHAR) AS code, pageviews_cnt, visitors_cnt, visit_seconds, percentage
    FROM ({figures}) g
  UNION ALL SELECT 'Series', {label}, {code}, {_measures('NULL')} {rows} GROUP BY 2, 3
  UNION ALL SELECT 'Map', edge_country, country_code, {_measures(percent('visitor_cnt'))}
    FROM stats LEFT JOIN countries ON country = edge_country WHERE {_DOMAIN} AND {now} GROUP BY 2, 3
""" + "".join(f"""  UNION ALL SELECT '{title}', coalesce({column}, 'Unknown'), NULL, {_measures(percent(reports.METRICS[metric]))}
    {rows} GROUP BY 2
""" for title, (column, metric) in reports.BREAKDOWNS.items()) + f""") u
UNION ALL SELECT 'Figures', 'delta', NULL, {', '.join(map(change, ('pageviews_cnt', 'visitors_cnt', 'visit_seconds')))}, NULL,
  {change('visit_duration_avg')} FROM (SELECT *, {average} FROM ({figures}) g) h"""


@query("report_full_day", _full(ONE_DAY))
def report_full_day(i: Inputs) -> DataFrame:
    return full_report(src.stats(i.spark, i.stored_stats()), DOMAIN, ONE_DAY, i.countries, details=True)


@query("report_full_month", _full(THIRTY))
def report_full_month(i: Inputs) -> DataFrame:
    return full_report(src.stats(i.spark, i.stored_stats()), DOMAIN, THIRTY, i.countries, details=True)


@query("report_full_year", _full(YEAR))
def report_full_year(i: Inputs) -> DataFrame:
    return full_report(src.stats(i.spark, i.stored_stats()), DOMAIN, YEAR, i.countries, details=True)

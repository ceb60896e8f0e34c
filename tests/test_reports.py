"""Reports: periods, labels, filters, and divisions by nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import times
from footfall.operators import dates, dimensions, reports
from footfall.plans.report import report


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture
def stats(spark):
    rows = [
        # day, hour, path, browser, country, views, visitors, seconds
        ("2024-01-30", 0, "/a", "Chrome", "Germany", 5, 2, 100),
        ("2024-01-30", 13, "/b", None, "France", 3, 1, 50),
        ("2024-01-30", 13, "/a", "Firefox", "Germany", 1, 0, 0),
        ("2024-01-29", 12, "/a", "Chrome", "Atlantis", 7, 3, 30),
        ("2023-12-31", 1, "/c", "Chrome", "Germany", 2, 1, 10),
    ]
    df = spark.createDataFrame(rows, "day string, event_hour int, request_path string, browser_name string, "
                                     "edge_country string, page_views_cnt int, visitor_cnt int, "
                                     "visit_duration_sec_avg int")
    df = df.withColumns({"event_date": F.col("day").cast("date"), "domain_name": F.lit("a.example"),
                         "bounce_cnt": F.lit(0)})
    for name in schemas.names(schemas.STATS):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None))
    return schemas.conform(df, schemas.STATS)


DAY = dates.Period(d("2024-01-30"), d("2024-01-30"), d("2024-01-29"), d("2024-01-29"), "hourly")
ALL = dates.Period(d("2023-12-01"), d("2024-01-31"), d("2023-10-01"), d("2023-11-30"), "monthly")


def test_presets_clamp_to_month_ends(spark):
    anchors = spark.createDataFrame([(d("2024-03-31"),), (d("2024-02-29"),)], "anchor_date date")
    rows = {(str(r.anchor_date), r.key): tuple(str(r[f]) for f in dates.FIELDS)
            for r in dates.date_ranges(anchors).collect()}
    assert rows["2024-03-31", "thismonth"] == ("2024-03-01", "2024-03-31", "2024-02-01", "2024-02-29", "daily")
    assert rows["2024-02-29", "thisyear"] == ("2024-01-01", "2024-02-29", "2023-01-01", "2023-02-28", "monthly")
    assert rows["2024-03-31", "thisweek"] == ("2024-03-25", "2024-03-31", "2024-03-18", "2024-03-24", "daily")
    assert rows["2024-02-29", "last7days"] == ("2024-02-22", "2024-02-29", "2024-02-15", "2024-02-21", "daily")
    assert len(rows) == 2 * len(dates.PRESETS)
    assert dates.preset(spark, "today", d("2024-02-29")).granularity == "hourly"
    with pytest.raises(ValueError):
        dates.preset(spark, "someday", d("2024-02-29"))


def test_custom_periods(spark):
    assert dates.custom(spark, d("2024-01-05")) == (
        d("2024-01-05"), d("2024-01-05"), d("2024-01-05"), d("2024-01-04"), "hourly")
    assert dates.custom(spark, d("2024-01-05"), d("2024-01-09")) == (
        d("2024-01-05"), d("2024-01-09"), d("2024-01-01"), d("2024-01-04"), "daily")
    assert dates.custom(spark, d("2024-01-05"), d("2024-01-09"), align=True).comparison_start == d("2023-12-31")
    assert dates.custom(spark, d("2024-01-01"), d("2024-03-31")).granularity == "daily"
    assert dates.custom(spark, d("2024-01-01"), d("2024-04-01")).granularity == "monthly"


def test_figures_and_change(stats):
    row = reports.kpi_compare(stats, "a.example", DAY).first()
    assert (row.current_pageviews, row.comparison_pageviews, row.pageviews_delta) == (9, 7, 2)
    assert (row.current_visit_duration_avg, row.comparison_visit_duration_avg) == (50.0, 10.0)
    weighted = reports.kpi_totals(reports.selected(stats, "a.example", DAY), weighted=True).first()
    assert weighted.visit_duration_avg == round((2 * 100 + 50) / 3)


def test_nothing_to_report(stats):
    row = reports.kpi_compare(stats, "b.example", DAY).first()
    assert row.current_pageviews is None and row.current_visit_duration_avg is None
    none = reports.selected(stats, "b.example", DAY)
    assert reports.breakdown(none, "request_path").count() == 0
    no_visitors = reports.selected(stats, "a.example", DAY, {"browser_name": "Firefox"})
    assert reports.kpi_totals(no_visitors).first().visit_duration_avg is None
    assert [tuple(r) for r in reports.breakdown(no_visitors, "request_path").collect()] == [("/a", 0, 0)]


def test_series(stats):
    hours = [tuple(r) for r in reports.series(stats, "a.example", DAY).collect()]
    assert hours == [(0, "0AM", 5, 2), (13, "1PM", 4, 1)]
    months = [tuple(r)[1:] for r in reports.series(stats, "a.example", ALL).collect()]
    assert months == [("December", 2, 1), ("January", 16, 6)]
    by_day = reports.series(stats, "a.example", ALL, {"event_date": "2024-01-29"}).collect()
    assert [tuple(r) for r in by_day] == [(12, "0PM", 7, 3)]


def test_filters(stats):
    def views(**chosen):
        return reports.kpi_totals(reports.selected(stats, "a.example", ALL, chosen)).first().pageviews_cnt

    assert views(browser_name="Unknown") == 3 and views(browser_name=None) == 3
    assert views(event_month="2024-01", browser_name="Chrome") == 12
    assert views(event_hour=13) == 4
    with pytest.raises(ValueError):
        reports.drilldown(stats, {"page_views_cnt": 1})


def test_breakdowns_in_one_pass_equal_single_ones(stats):
    rows = reports.selected(stats, "a.example", ALL)
    every = reports.breakdowns(rows).collect()
    for title, (column, metric) in reports.BREAKDOWNS.items():
        single = [tuple(r) for r in reports.breakdown(rows, column, metric).collect()]
        assert [(r.name, r.value, r.percentage) for r in every if r.header == title] == single
    assert {r.name for r in every if r.header == "Browsers"} == {"Chrome", "Firefox", "Unknown"}


def test_countries_and_codes(spark, stats):
    dim = dimensions.countries(spark)
    assert dim.count() == 50 == dim.select("country_code").distinct().count()
    rows = [tuple(r) for r in reports.countries(reports.selected(stats, "a.example", DAY), dim).collect()]
    assert rows == [("Germany", "de", 2, 2 / 3), ("France", "fr", 1, 1 / 3)]
    back = dimensions.with_country_name(spark.createDataFrame([("nz",), ("xx",)], "country_code string"), dim)
    assert {r.country_code: r.country for r in back.collect()} == {"nz": "New Zealand", "xx": None}


def test_report_bundle(spark, stats):
    parts = report(stats, "a.example", DAY, dimensions.countries(spark), {"request_path": "/a"})
    assert parts.figures.first().current_pageviews == 6
    assert parts.series.count() == 2 and parts.countries.count() == 1
    assert parts.breakdowns.where("header = 'Pages'").count() == 1


def test_texts(spark):
    df = spark.createDataFrame([(61, 10, 4), (3600, 4, 10), (445555, 7, 0), (0, 1500, None)], "s int, a int, b int")
    rows = df.select(times.duration_text(F.col("s")), times.delta_text(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("01:01", "+6"), ("1:00:00", "-6"), ("123:45:55", "+7"), ("00:00", "+1,500")]


def test_join_beyond_the_broadcast_bound(spark):
    events = spark.range(100).select(F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("k"))
    dim = spark.createDataFrame([("e0", 1), ("e1", 2)], "k string, v int")
    small = events.join(dimensions.broadcast_if_small(dim), "k", "left")
    large = events.join(dimensions.broadcast_if_small(dim, max_bytes=1), "k", "left")
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)

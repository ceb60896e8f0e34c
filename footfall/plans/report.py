"""Everything a dashboard page shows, as a bundle of DataFrames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import times
from footfall.operators import dimensions, reports
from footfall.operators.dates import Period
from footfall.session import scratch


class Report(NamedTuple):
    figures: DataFrame
    series: DataFrame
    countries: DataFrame
    breakdowns: DataFrame


def report(stats: DataFrame, domain: str, period: Period, countries: DataFrame,
           filters: reports.Filters | None = None) -> Report:
    """Key figures, time series, countries and all breakdowns of a domain and period."""
    rows = reports.selected(stats, domain, period, filters)
    return Report(
        reports.kpi_compare(stats, domain, period, filters),
        reports.series(stats, domain, period, filters),
        reports.countries(rows, countries),
        reports.breakdowns(rows))


def full_report(stats: DataFrame, domain: str, period: Period, countries: DataFrame,
                filters: reports.Filters | None = None, details: bool = False) -> DataFrame:
    """The whole page as one table: (section, name, code, pageviews_cnt, visitors_cnt, visit_seconds, percentage).

    Sections are ``Figures`` (``current`` and ``comparison``), ``Series``, ``Map`` (countries with their codes) and
    the breakdowns. The series is by hour of day, day or month as the period says, by hour if a day is selected; hours and months have a
    code that sorts them. The range is read once: all sections are grouping sets of one aggregation, whose rows, few beside the
    table's, are written to the scratch folder and read back for the totals.

    ``details`` adds ``visit_duration_avg``, the visit time of each row, and the figure ``delta``, the change against the comparison.
    """
    day = F.col("event_date")
    granularity = "hourly" if filters and "event_date" in filters else period.granularity
    bucket = {"hourly": F.format_string("%02d", "event_hour"), "daily": F.date_format(day, "yyyy-MM-dd"),
              "monthly": F.date_format(day, "yyyy-MM")}[granularity]
    label = {"hourly": times.hour_label(F.col("bucket").cast("int")), "daily": F.col("bucket"),
             "monthly": times.month_label(F.concat("bucket", F.lit("-01")).cast("date"))}[granularity]

    def within(start, end):
        return day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))

    now, then = within(period.start, period.end), within(period.comparison_start, period.comparison_end)
    rows = reports.drilldown(stats, filters).where((F.col("domain_name") == domain) & (now | then))
    columns = list(dict.fromkeys(c for c, _ in reports.BREAKDOWNS.values()))
    rows = rows.select(
        F.when(now, "current").otherwise("comparison").alias("part"), bucket.alias("bucket"),
        F.col("edge_country").alias("country"), *[times.unknown(F.col(c)).alias(f"by_{c}") for c in columns],
        "page_views_cnt", "visitor_cnt", "visit_duration_sec_avg")
    names = ["bucket", "country", *[f"by_{c}" for c in columns]]
    grouped = rows.groupingSets([["part"], *[["part", c] for c in names]], "part", *names).agg(
        *[F.grouping(c).alias(f"without_{c}") for c in names], F.sum("page_views_cnt").cast("bigint").alias("pageviews_cnt"),
        F.sum("visitor_cnt").cast("bigint").alias("visitors_cnt"), F.sum("visit_duration_sec_avg").cast("bigint").alias("visit_seconds"))
    path = scratch(stats.sparkSession, "report")
    grouped.write.parquet(path)
    grouped = stats.sparkSession.read.schema(grouped.schema).parquet(path)

    alone = F.lit(True)
    for c in names:
        alone = alone & (F.col(f"without_{c}") == 1)
    figures = grouped.where(alone)
    current = grouped.where("part = 'current'")
    total = figures.where("part = 'current'")
    views, visitors = (total.select(c).scalar() for c in ("pageviews_cnt", "visitors_cnt"))

    def section(df: DataFrame, title: str, name, code=None, percentage=None) -> DataFrame:
        return df.select(F.lit(title).alias("section"), name.alias("name"), (F.lit(None) if code is None else code).cast("string").alias("code"),
                         "pageviews_cnt", "visitors_cnt", "visit_seconds",
                         (F.lit(None) if percentage is None else percentage).cast("bigint").alias("percentage"))

    by_country = dimensions.with_country_code(current.where("without_country = 0"), countries, "country")
    parts = [section(figures, "Figures", F.col("part")), section(current.where("without_bucket = 0"), "Series", label, None if granularity == "daily" else F.col("bucket")),
             section(by_country, "Map", F.col("country"), F.col("country_code"), reports.whole_percent(F.col("visitors_cnt"), visitors))]
    for title, (column, metric) in reports.BREAKDOWNS.items():
        measure, of = ("pageviews_cnt", views) if metric == "Pageviews" else ("visitors_cnt", visitors)
        parts.append(section(current.where(f"without_by_{column} = 0"), title, F.col(f"by_{column}"), None,
                             reports.whole_percent(F.col(measure), of)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    if not details:
        return result
    result = result.withColumn("visit_duration_avg", F.round(F.try_divide("visit_seconds", "visitors_cnt")))
    measures = ["pageviews_cnt", "visitors_cnt", "visit_seconds"]
    both = figures.withColumn("visit_duration_avg", F.round(F.try_divide("visit_seconds", "visitors_cnt"))).agg(*[
        times.delta(*[F.max(F.when(F.col("part") == p, F.col(c))) for p in ("current", "comparison")]).alias(c)
        for c in (*measures, "visit_duration_avg")])
    return result.unionByName(both.select(
        F.lit("Figures").alias("section"), F.lit("delta").alias("name"), F.lit(None).cast("string").alias("code"), *measures,
        F.lit(None).cast("bigint").alias("percentage"), "visit_duration_avg"))

"""Questions asked of the statistics table."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import times
from footfall.operators import dimensions
from footfall.operators.dates import Period

# Metric -> measure.
METRICS = {"Pageviews": "page_views_cnt", "Visitors": "visitor_cnt"}
# Title of a breakdown -> (stored column, metric).
BREAKDOWNS = {
    "Pages": ("request_path", "Pageviews"),
    "Referrers": ("referrer_domain_name", "Pageviews"),
    "Browsers": ("browser_name", "Visitors"),
    "Operating Systems": ("browser_os_name", "Visitors"),
    "Device Type": ("device_type", "Visitors"),
    "Countries": ("edge_country", "Visitors"),
}
UNKNOWN = "Unknown"
Filters = Mapping[str, object]


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def in_period(stats: DataFrame, domain: str, start, end) -> DataFrame:
    """Rows of a domain between two dates, both included."""
    day = F.col("event_date")
    return stats.where((F.col("domain_name") == domain)
                       & day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drilldown(stats: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Keep rows equal to every selected value.

    Columns are the dimensions, plus ``event_month`` given as ``yyyy-MM``. The value
    ``Unknown`` (or None) selects missing values.
    """
    conditions = []
    for name, value in (filters or {}).items():
        if name == "event_month":
            conditions.append(F.date_format("event_date", "yyyy-MM") == value)
        elif name not in schemas.DIMS:
            raise ValueError(f"{name!r} is no dimension")
        elif value is None:
            conditions.append(F.col(name).isNull())
        elif value == UNKNOWN:
            conditions.append(F.col(name).isNull() | (F.col(name).cast("string") == UNKNOWN))
        elif name == "event_date":
            conditions.append(F.col(name) == F.lit(value).cast("date"))
        else:
            conditions.append(F.col(name) == F.lit(value))
    return stats.where(_all(conditions)) if conditions else stats


def selected(stats: DataFrame, domain: str, period: Period, filters: Filters | None = None) -> DataFrame:
    return drilldown(in_period(stats, domain, period.start, period.end), filters)


def _total(c: str) -> Column:
    return F.sum(c).cast("bigint")


def kpi_totals(rows: DataFrame, weighted: bool = False) -> DataFrame:
    """Page views, visitors and visit time of the rows given.

    The visit time divides the summed group averages by the visitors. ``weighted``
    weighs every group by its visitors instead, which gives the true mean.
    """
    seconds = F.col("visit_duration_sec_avg") * (F.col("visitor_cnt") if weighted else F.lit(1))
    return rows.agg(
        _total("page_views_cnt").alias("pageviews_cnt"),
        _total("visitor_cnt").alias("visitors_cnt"),
        F.round(F.try_divide(F.sum(seconds), F.sum("visitor_cnt"))).alias("visit_duration_avg"))


def kpi_compare(stats: DataFrame, domain: str, period: Period, filters: Filters | None = None) -> DataFrame:
    """Key figures of a period, of its comparison period, and the change; one scan."""
    day = F.col("event_date")

    def within(start, end) -> Column:
        return day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))

    now = within(period.start, period.end)
    then = within(period.comparison_start, period.comparison_end)
    rows = drilldown(stats, filters).where((F.col("domain_name") == domain) & (now | then))

    def figures(prefix: str, where: Column) -> list[Column]:
        def part(c: str) -> Column:
            return F.sum(F.when(where, F.col(c))).cast("bigint")

        return [part("page_views_cnt").alias(f"{prefix}_pageviews"),
                part("visitor_cnt").alias(f"{prefix}_visitors"),
                F.round(F.try_divide(part("visit_duration_sec_avg"), part("visitor_cnt")))
                 .alias(f"{prefix}_visit_duration_avg")]

    one = rows.agg(*figures("current", now), *figures("comparison", then))
    return one.withColumns({
        f"{name}_delta": times.delta(F.col(f"current_{name}"), F.col(f"comparison_{name}"))
        for name in ("pageviews", "visitors", "visit_duration_avg")})


def time_series(rows: DataFrame, granularity: str) -> DataFrame:
    """Page views and visitors per hour of day, per day or per month, in time order."""
    bucket, label = {
        "hourly": (F.col("event_hour"), times.hour_label),
        "daily": (F.col("event_date"), times.day_label),
        "monthly": (F.trunc("event_date", "month"), times.month_label),
    }[granularity]
    grouped = rows.groupBy(bucket.alias("bucket")).agg(
        _total("page_views_cnt").alias("pageviews_cnt"), _total("visitor_cnt").alias("visitors_cnt"))
    return grouped.select("bucket", label(F.col("bucket")).alias("date_granularity"),
                          "pageviews_cnt", "visitors_cnt").orderBy("bucket")


def series(stats: DataFrame, domain: str, period: Period, filters: Filters | None = None) -> DataFrame:
    """Time series of a period; selecting one day switches to hours."""
    granularity = "hourly" if filters and "event_date" in filters else period.granularity
    return time_series(selected(stats, domain, period, filters), granularity)


def whole_percent(value: Column, total: Column) -> Column:
    """Rounded percent; 0 when there is nothing to divide by."""
    return F.coalesce(F.floor(F.try_divide(value, total) * 100 + 0.5), F.lit(0)).cast("bigint")


def breakdown(rows: DataFrame, dimension: str, metric: str = "Visitors", n: int | None = None) -> DataFrame:
    """Value and share per dimension value, largest first; ``n`` gives a top-n report.

    The total is a scalar subquery over the grouped rows, so no task sees all of them.
    """
    grouped = rows.groupBy(times.unknown(F.col(dimension)).alias("name")).agg(
        _total(METRICS[metric]).alias("value"))
    total = grouped.agg(F.sum("value").alias("total")).scalar()
    shares = grouped.withColumn("percentage", whole_percent(F.col("value"), total))
    ordered = shares.orderBy(F.desc_nulls_last("value"), F.asc("name"))
    return ordered if n is None else ordered.limit(n)


def breakdowns(rows: DataFrame) -> DataFrame:
    """All six breakdowns in one pass, as (header, metric, name, value, percentage)."""
    columns = [c for c, _ in BREAKDOWNS.values()]
    named = rows.select(*[times.unknown(F.col(c)).alias(c) for c in columns], "page_views_cnt", "visitor_cnt")
    grouped = named.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id(*columns).alias("_set"),
        _total("page_views_cnt").alias("_views"), _total("visitor_cnt").alias("_visitors"))
    totals = named.agg(_total("page_views_cnt").alias("views"), _total("visitor_cnt").alias("visitors"))

    # The grouping id has one bit per column, set when the column is not grouped.
    every = (1 << len(columns)) - 1
    header, metric, name = F.lit(None), F.lit(None), F.lit(None)
    for i, (title, (column, kind)) in enumerate(BREAKDOWNS.items()):
        mine = F.col("_set") == every - (1 << (len(columns) - 1 - i))
        header = F.when(mine, title).otherwise(header)
        metric = F.when(mine, kind).otherwise(metric)
        name = F.when(mine, F.col(column)).otherwise(name)
    by_views = F.col("metric") == "Pageviews"
    labelled = grouped.select(header.alias("header"), metric.alias("metric"), name.alias("name"),
                              "_views", "_visitors")
    total = F.when(by_views, totals.select("views").scalar()).otherwise(totals.select("visitors").scalar())
    valued = labelled.withColumn("value", F.when(by_views, F.col("_views")).otherwise(F.col("_visitors")))
    return valued.select("header", "metric", "name", "value",
                         whole_percent(F.col("value"), total).alias("percentage")
                         ).orderBy("header", F.desc("value"), "name")


def with_share(grouped: DataFrame, value: str = "value") -> DataFrame:
    """Add each row's part of the total."""
    total = grouped.agg(F.sum(value).alias("total")).scalar()
    return grouped.withColumn("share", F.try_divide(F.col(value), total))


def countries(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Visitors per country with ISO code and share, largest first."""
    grouped = rows.groupBy("edge_country").agg(_total("visitor_cnt").alias("value"))
    coded = dimensions.with_country_code(with_share(grouped), dim)
    return coded.select("edge_country", "country_code", "value", "share").orderBy(
        F.desc("value"), "edge_country")


def domain_names(stats: DataFrame) -> DataFrame:
    return stats.select("domain_name").distinct().orderBy("domain_name")


def latest_date(stats: DataFrame) -> DataFrame:
    """The newest date held."""
    return stats.agg(F.max("event_date").alias("max_event_date"))

"""The two scheduled jobs. Scheduling is the caller's; the run date is an argument."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators import stats
from footfall.plans import serving
from footfall.sinks import tables as out


class Layout(NamedTuple):
    """Folders of the stored tables below one root."""

    root: str

    @property
    def stats(self) -> str:
        return f"{self.root}/stats"

    @property
    def today(self) -> str:
        return f"{self.root}/daily-stats"

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def history(self) -> str:
        return f"{self.root}/history"


def nightly(spark: SparkSession, incoming: DataFrame, layout: Layout, run_date: dt.date, mode: str = "gap",
            since=None, distinct: bool = False) -> list[dt.date]:
    """Close yesterday and the dates with arrivals ``since`` a moment: statistics, custom events, then the served history.

    ``distinct`` drops repeated deliveries first. Returns the days that history got anew.
    """
    yesterday = run_date - dt.timedelta(days=1)
    incoming = stats.without_repeats(incoming) if distinct else incoming
    days = {yesterday}
    if since is not None:
        touched = serving.touched_days(incoming, since).where(F.col("event_date") < F.lit(run_date))
        days |= {r.event_date for r in touched.collect()}
    serving.recompute(incoming, days, layout.stats, layout.events, mode)
    return serving.refresh_history(spark, layout.stats, layout.history, run_date, days)


def hourly(incoming: DataFrame, layout: Layout, run_date: dt.date, mode: str = "gap", distinct: bool = False) -> None:
    """Recompute today's statistics."""
    incoming = stats.without_repeats(incoming) if distinct else incoming
    out.replace_days(stats.daily_stats(incoming, run_date, mode), layout.today, out.write_today, [run_date])

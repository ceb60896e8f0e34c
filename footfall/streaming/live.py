"""Continuous counts and visits over streams of cleaned events.

State is bounded by the watermark. Visits and visitors are grouped by key and time,
and Spark combines both before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.sessions import GAP_SECONDS, VISITOR
from footfall.sinks import commits

LATENESS = "10 minutes"


def hourly_pageviews(views: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Page views per domain and hour, with an approximate number of visitors."""
    hour = F.window("event_timestamp", "1 hour")
    return views.withWatermark("event_timestamp", lateness).groupBy("domain_name", hour).agg(
        F.count("page_view_id").alias("page_views_cnt"),
        F.approx_count_distinct("daily_visitor_id").alias("approx_visitor_cnt"),
    ).select("domain_name", F.col("window.start").alias("hour_start"), "page_views_cnt", "approx_visitor_cnt")


def hourly_visitors(views: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Exact visitors per domain and hour: drop repeats first, then count.

    Both steps are keyed by the end of the hour and keep their state until the watermark
    has passed it, so a visitor who returns late in the hour is not counted again. The
    watermark trails the newest hour by one hour more than the lateness, because the end
    of an hour is known as soon as the hour begins.
    """
    hour_end = F.date_trunc("hour", "event_timestamp") + F.expr("interval 1 hour")
    once = (views.withColumn("hour_end", hour_end).withWatermark("hour_end", f"1 hour {lateness}")
            .dropDuplicates(["domain_name", "hour_end", "daily_visitor_id"]))
    return once.groupBy("domain_name", "hour_end").agg(F.count("daily_visitor_id").alias("visitor_cnt")).select(
        "domain_name", (F.col("hour_end") - F.expr("interval 1 hour")).alias("hour_start"), "visitor_cnt")


def stream_sessions(views: DataFrame, gap: int = GAP_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Visits on a stream; a visit is emitted once the watermark has passed its end."""
    second = views.withColumn("event_second", F.date_trunc("second", "event_timestamp"))
    visit = F.session_window("event_second", f"{gap} seconds")
    found = second.withWatermark("event_second", lateness).groupBy(*VISITOR, visit).agg(
        F.min("event_timestamp").alias("session_start_timestamp"),
        F.max("event_timestamp").alias("session_end_timestamp"),
        F.count("page_view_id").alias("page_views_cnt"))
    start, end = F.col("session_start_timestamp"), F.col("session_end_timestamp")
    return found.select(
        *VISITOR, "session_start_timestamp", "session_end_timestamp", "page_views_cnt",
        (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("visit_duration_sec"))


def deduplicated(events: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """First delivery of every event; repeats inside the watermark are dropped."""
    return events.withWatermark("event_timestamp", lateness).dropDuplicatesWithinWatermark(keys)


def append_to(df: DataFrame, path: str, checkpoint: str, every: str | None = "1 minute") -> StreamingQuery:
    """Append finished rows to a Parquet folder, exactly once."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (df.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def keep_newest(df: DataFrame, path: str, checkpoint: str, every: str | None = "1 minute") -> StreamingQuery:
    """Write the groups that changed, batch by batch; ``newest`` reads the last state of each.

    The watermark bounds the state, and a batch holds only groups that got rows, so neither grows with the age of the stream.
    A repeated batch replaces its folder. ``merge_batches`` keeps the number of folders small.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return (df.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def written(spark: SparkSession, path: str) -> DataFrame:
    """What ``keep_newest`` has written, merged or not, with ``batch_id``."""
    return commits.read(spark, path)


def _last(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch_id", *rest)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (*rest, "batch_id")])


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last written row of each group of what ``keep_newest`` wrote."""
    return _last(rows, keys).drop("batch_id")


def merge_batches(spark: SparkSession, path: str, keys: Sequence[str], before: int, keep: int = 1) -> None:
    """One folder with the newest rows in place of the batches before a number, under a commit record (see ``commits``)."""
    commits.merge(spark, path, before, lambda rows, to: _last(rows, keys).write.mode("overwrite").parquet(to), keep=keep)


def finish(complete: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Close a stream whose input has ended: add the rows that the watermark never released; returns all rows.

    ``complete`` is the batch result of the same operator over the input, or over its part since the last
    released row; rows that ``append_to`` has written already are recognised by their keys. The added rows have a folder of
    their own beside the stream's, which lists its files itself; closing again replaces it.
    """
    written = complete.sparkSession.read.schema(complete.schema).parquet(path)
    rest = f"{path}-closing"
    complete.join(written.select(*keys), list(keys), "left_anti").select(*complete.columns).write.mode("overwrite").parquet(rest)
    return written.unionByName(complete.sparkSession.read.schema(complete.schema).parquet(rest))

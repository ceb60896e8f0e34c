"""Streams over the test tables, run until everything present is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from footfall import schemas
from footfall.catalog.book import query
from footfall.catalog.inputs import Inputs
from footfall.operators import parsing, stats
from footfall.operators.sessions import VISITOR
from footfall.sources.access_log import stream_lines
from footfall.streaming import ingest, live, objects, today


def _drain(start, *args, **options) -> None:
    start(*args, every=None, **options).awaitTermination()


@query("stream_ingest", """
SELECT domain_name, CASE WHEN is_event THEN 'event' ELSE 'pageview' END AS event_type, event_date, event_timestamp,
  request_path FROM hits WHERE later_error IS NULL""")
def stream_ingest(i: Inputs) -> DataFrame:
    targets = ingest.Targets(i.scratch("ingest"))
    _drain(ingest.start_ingest, i.raw_stream(), lambda: ingest.Dimensions(i.domains, i.edges, i.salts), targets,
           i.scratch("checkpoint"))
    return ingest.stored(i.spark, targets).select(
        "domain_name", "event_type", "event_date", "event_timestamp", "request_path")


@query("stream_verify_domains", "SELECT event_timestamp, domain_name FROM hits WHERE event_id % 17 <> 0")
def stream_verify_domains(i: Inputs) -> DataFrame:
    path = i.scratch("verified")
    hits = parsing.read_hits(i.raw_stream()).where("error is null").select(
        "event_timestamp", "domain_name", "domain_key")
    _drain(ingest.verified_stream, hits, lambda: i.domains,
           lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}"), i.scratch("checkpoint"))
    return i.spark.read.parquet(path).select("event_timestamp", "domain_name")


@query("stream_hourly", """
SELECT domain_name, date_trunc('hour', event_timestamp) AS hour_start, count(page_view_id) AS page_views_cnt
FROM views GROUP BY 1, 2""")
def stream_hourly(i: Inputs) -> DataFrame:
    path = i.scratch("hourly")
    _drain(live.keep_newest, live.hourly_pageviews(stats.pageviews(i.pv_stream())), path, i.scratch("checkpoint"))
    return live.newest(live.written(i.spark, path), ["domain_name", "hour_start"]).select(
        "domain_name", "hour_start", "page_views_cnt")


@query("stream_hourly_visitors", """
SELECT domain_name, date_trunc('hour', event_timestamp) AS hour_start, count(DISTINCT daily_visitor_id) AS visitor_cnt
FROM views GROUP BY 1, 2""")
def stream_hourly_visitors(i: Inputs) -> DataFrame:
    path = i.scratch("visitors")
    _drain(live.append_to, live.hourly_visitors(stats.pageviews(i.pv_stream())), path, i.scratch("checkpoint"))
    return live.finish(live.hourly_visitors(stats.pageviews(i.pv)), path, ["domain_name", "hour_start"])


@query("stream_sessions", """
SELECT domain_name, event_date, daily_visitor_id, session_start AS session_start_timestamp,
  session_end AS session_end_timestamp, n_views AS page_views_cnt, visit_duration_sec
FROM sessions""")
def stream_sessions(i: Inputs) -> DataFrame:
    path = i.scratch("visits")
    _drain(live.append_to, live.stream_sessions(stats.pageviews(i.pv_stream())), path, i.scratch("checkpoint"))
    return live.finish(live.stream_sessions(stats.pageviews(i.pv)), path, [*VISITOR, "session_start_timestamp"])


@query("stream_dedup", "SELECT page_view_id, domain_name, event_timestamp FROM pv")
def stream_dedup(i: Inputs) -> DataFrame:
    path = i.scratch("dedup")
    columns = ["page_view_id", "domain_name", "event_timestamp"]
    twice = i.pv_stream().select(*columns).unionByName(i.pv_stream().select(*columns))
    _drain(live.append_to, live.deduplicated(twice, ["page_view_id"]), path, i.scratch("checkpoint"))
    return i.spark.read.schema("page_view_id string, domain_name string, event_timestamp timestamp").parquet(path)


@query("stream_ingest_redelivered", """
SELECT domain_name, CASE WHEN is_event THEN 'event' ELSE 'pageview' END AS event_type, event_date, event_timestamp,
  request_path FROM hits WHERE later_error IS NULL""")
def stream_ingest_redelivered(i: Inputs) -> DataFrame:
    """All lines are delivered in two batches, and count once."""
    lines, targets = i.scratch("lines"), ingest.Targets(i.scratch("ingest"))
    dims = ingest.Dimensions(i.domains, i.edges, i.salts)
    checkpoint = i.scratch("checkpoint")
    for _ in range(2):
        i.raw_log.write.mode("append").text(lines)
        _drain(ingest.start_ingest, stream_lines(i.spark, lines), lambda: dims, targets, checkpoint, once="1 day")
    return ingest.stored(i.spark, targets).select(
        "domain_name", "event_type", "event_date", "event_timestamp", "request_path")


@query("stream_ingest_compacted", """
SELECT domain_name, CASE WHEN is_event THEN 'event' ELSE 'pageview' END AS event_type, event_date, event_timestamp,
  request_path FROM hits WHERE later_error IS NULL
UNION ALL SELECT domain_name, CASE WHEN is_event THEN 'event' ELSE 'pageview' END, event_date, event_timestamp, request_path
  FROM hits WHERE later_error IS NULL""")
def stream_ingest_compacted(i: Inputs) -> DataFrame:
    """Three batches, of which the first two are merged under a commit record."""
    targets = ingest.Targets(i.scratch("ingest"))
    write = ingest.batch_writer(lambda: ingest.Dimensions(i.domains, i.edges, i.salts), targets)
    for number in range(2):
        write(i.raw_log, number)
    write(i.raw_log.limit(0), 2)
    ingest.compact(i.spark, targets, before=2, keep=0)
    return ingest.stored(i.spark, targets).select(
        "domain_name", "event_type", "event_date", "event_timestamp", "request_path")


@query("stream_manifest", """
SELECT s3_key, event_time AS file_created_timestamp, file_size,
  CASE WHEN s3_key LIKE 'incoming/%' THEN 'cleaned' ELSE 'curated' END AS file_type,
  CAST(regexp_extract(s3_key, 'event_date=([^/]*)', 1) AS DATE) AS file_event_date
FROM (SELECT *, row_number() OVER (PARTITION BY s3_key ORDER BY event_time DESC) AS rn FROM object_events) n
WHERE rn = 1 AND event_name LIKE 'ObjectCreated%'""")
def stream_manifest(i: Inputs) -> DataFrame:
    """Every notification comes twice."""
    path = i.scratch("files")
    _drain(objects.follow, i.notification_stream().unionByName(i.notification_stream()), path, i.scratch("checkpoint"))
    return objects.files(i.spark, path).select("s3_key", "file_created_timestamp", "file_size", "file_type", "file_event_date")


@query("stream_today_stats", f"SELECT {', '.join(schemas.names(schemas.STATS))} FROM stats")
def stream_today_stats(i: Inputs) -> DataFrame:
    place = today.Today(i.scratch("today"))
    for running in today.start(stats.pageviews(i.pv_stream()), place, i.scratch("checkpoint"), every=None):
        running.awaitTermination()
    return today.table(i.spark, place)

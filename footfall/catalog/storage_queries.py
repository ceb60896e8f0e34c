"""Stored tables, jobs, registry and manifest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.catalog.book import query
from footfall.catalog.inputs import DAY, DOMAIN, FORTNIGHT, RUN_DATE, Inputs
from footfall.operators import distincts, manifest, parsing, partials, registry, reports, stats, timeline
from footfall.plans import jobs, ledger, serving
from footfall.sinks import exports, raw
from footfall.sinks import tables as out
from footfall.sources import tables as src
from footfall.sources.notifications import read_notifications

_STATS = ", ".join(schemas.names(schemas.STATS))
_EVENTS = ", ".join(schemas.names(schemas.EVENTS))
BEFORE = DAY - dt.timedelta(days=1)
CUTOFF = "2024-01-20 00:00:00"


def _until(df: DataFrame, day) -> DataFrame:
    return df.where(F.col("event_date") <= F.lit(day).cast("date"))


@query("scan_stats_all", f"SELECT {_STATS} FROM stats")
def scan_stats_all(i: Inputs) -> DataFrame:
    return src.stats(i.spark, i.stored_stats())


@query("scan_stats_range", f"SELECT {_STATS} FROM stats WHERE event_date BETWEEN DATE '{DAY}' AND DATE '2024-01-20'")
def scan_stats_range(i: Inputs) -> DataFrame:
    return src.stats_between(i.spark, i.stored_stats(), DAY, "2024-01-20")


@query("empty_stats_table", f"SELECT {_STATS} FROM stats")
def empty_stats_table(i: Inputs) -> DataFrame:
    return schemas.empty(i.spark, schemas.STATS).unionByName(i.stats)


@query("sink_stats_roundtrip", f"SELECT {_STATS} FROM stats")
def sink_stats_roundtrip(i: Inputs) -> DataFrame:
    path = i.scratch("stats")
    out.write_stats(i.stats, path)
    return src.stats(i.spark, path)


@query("sink_stats_rerun", f"SELECT {_STATS} FROM stats")
def sink_stats_rerun(i: Inputs) -> DataFrame:
    path = i.scratch("stats")
    out.write_stats(i.stats, path)
    out.write_stats(stats.daily_stats(i.pv, DAY), path)
    return src.stats(i.spark, path)


@query("sink_hourly_roundtrip", f"SELECT {_STATS} FROM stats")
def sink_hourly_roundtrip(i: Inputs) -> DataFrame:
    path = i.scratch("today")
    out.write_today(i.stats, path)
    return src.stats(i.spark, path)


@query("scan_today_stats", f"SELECT {_STATS} FROM stats WHERE event_date = DATE '{RUN_DATE}'")
def scan_today_stats(i: Inputs) -> DataFrame:
    path = i.scratch("today")
    out.write_today(_until(i.stats, RUN_DATE), path)
    return src.stats_today(i.spark, path, RUN_DATE)


@query("sink_events_roundtrip", f"SELECT {_EVENTS} FROM pv WHERE event_type = 'event'")
def sink_events_roundtrip(i: Inputs) -> DataFrame:
    path = i.scratch("events")
    out.write_events(stats.curated_events(i.pv), path)
    return src.curated_events(i.spark, path)


@query("scan_curated_events", f"""
SELECT {_EVENTS} FROM pv WHERE event_type = 'event' AND domain_name = '{DOMAIN}'""")
def scan_curated_events(i: Inputs) -> DataFrame:
    path = i.scratch("events")
    out.write_events(stats.curated_events(i.pv), path)
    return src.curated_events(i.spark, path).where(F.col("domain_name") == DOMAIN)


@query("sink_incoming_roundtrip", """
SELECT domain_name, CASE WHEN is_event THEN 'event' ELSE 'pageview' END AS event_type, event_date,
  event_timestamp, request_path, CASE WHEN is_event THEN props END AS event_data, agent LIKE '%Bot%' AS is_bot
FROM hits WHERE later_error IS NULL""")
def sink_incoming_roundtrip(i: Inputs) -> DataFrame:
    path = i.scratch("incoming")
    out.write_incoming(parsing.parse_events(i.raw_log, i.domains, i.edges, i.salts), path)
    return src.incoming(i.spark, path).select(
        "domain_name", "event_type", "event_date", "event_timestamp", "request_path", "event_data",
        (F.col("request_is_bot") == 1).alias("is_bot"))


@query("sink_raw_backup", """
SELECT CAST(ts AS DATE) AS arrival_date, value
FROM (SELECT value, CAST(to_timestamp(CAST(split_part(value, '.', 1) AS BIGINT)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts
  FROM raw_log) r""")
def sink_raw_backup(i: Inputs) -> DataFrame:
    path = i.scratch("raw")
    raw.write_backup(i.raw_log, path)
    return i.spark.read.schema("value string, arrival_date date").text(path).select("arrival_date", "value")


@query("sink_dead_letter", """
SELECT event_date AS error_date, coalesce(hit_error, later_error) AS error_type, count(*) AS n
FROM log_truth WHERE coalesce(hit_error, later_error) IS NOT NULL GROUP BY 1, 2""")
def sink_dead_letter(i: Inputs) -> DataFrame:
    path = i.scratch("rejects")
    raw.write_rejects(parsing.parse_outcomes(i.raw_log, i.domains, i.edges, i.salts), path)
    stored = i.spark.read.schema("value string, message string, error_date date, error_type string").parquet(path)
    return stored.groupBy("error_date", "error_type").agg(F.count("value").alias("n"))


@query("export_csv_roundtrip", f"""
SELECT {_STATS} FROM stats WHERE domain_name = '{DOMAIN}'
  AND event_date BETWEEN DATE '{FORTNIGHT.start}' AND DATE '{FORTNIGHT.end}'""")
def export_csv_roundtrip(i: Inputs) -> DataFrame:
    name = exports.export_name(DOMAIN, FORTNIGHT.start, FORTNIGHT.end)
    path = f"{i.scratch('export')}/{name}"
    exports.export_csv(reports.selected(i.stats, DOMAIN, FORTNIGHT), path)
    return exports.read_csv(i.spark, path, schemas.STATS)


_SPECIAL = """
SELECT 'a.example' AS domain_name, DATE '2024-01-01' AS event_date, CAST(event_id % 24 AS INT) AS event_hour,
  concat(CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN '"' WHEN 2 THEN 'a;b' WHEN 3 THEN 'c\\d' WHEN 4 THEN concat('e', chr(10), 'f')
    WHEN 5 THEN '""' WHEN 6 THEN concat(' g ', chr(13), chr(10), '"h";') WHEN 7 THEN '\\"' ELSE '/i' END,
    CASE WHEN event_id % 9 = 0 THEN '' ELSE CAST(event_id AS STRING) END) AS request_path,
  CASE WHEN event_id % 2 = 0 THEN '' END AS utm_source, CAST(1 AS INT) AS page_views_cnt FROM events"""


@query("export_csv_special", _SPECIAL.replace("AS STRING", "AS VARCHAR"))
def export_csv_special(i: Inputs) -> DataFrame:
    """Quotes, delimiters, backslashes, line breaks, empty texts and NULL come back as they were."""
    columns = ["domain_name", "event_date", "event_hour", "request_path", "utm_source", "page_views_cnt"]
    special = i.run(_SPECIAL.replace("\\", "\\\\").replace("chr(", "char(").replace("FROM events", "FROM {events} e"))
    path = f"{i.scratch('export')}/special.csv"
    exports.export_csv(special.select(*columns), path)
    ddl = "domain_name string, event_date date, event_hour int, request_path string, utm_source string, page_views_cnt int"
    return exports.read_csv(i.spark, path, ddl)


@query("export_arrow", f"SELECT {_STATS} FROM stats")
def export_arrow(i: Inputs) -> DataFrame:
    chunks = exports.to_arrow_chunks(schemas.conform(i.stats, schemas.STATS))
    return exports.from_arrow_chunks(chunks, schemas.STATS)


@query("serve_union", f"SELECT {_STATS} FROM stats WHERE event_date <= DATE '{RUN_DATE}'")
def serve_union(i: Inputs) -> DataFrame:
    return serving.serve(_until(i.stats, DAY), stats.daily_stats(i.pv, RUN_DATE))


@query("serve_history_only", f"SELECT {_STATS} FROM stats WHERE event_date <= DATE '{DAY}'")
def serve_history_only(i: Inputs) -> DataFrame:
    return serving.serve(_until(i.stats, DAY))


@query("refresh_full", f"SELECT {_STATS} FROM stats")
def refresh_full(i: Inputs) -> DataFrame:
    path = i.scratch("history")
    serving.refresh_full(i.spark, i.stored_stats(), path)
    return serving.read_history(i.spark, path)


@query("refresh_incremental", f"SELECT {_STATS} FROM stats WHERE event_date <= DATE '{DAY}'")
def refresh_incremental(i: Inputs) -> DataFrame:
    path = i.scratch("history")
    serving.refresh_full(i.spark, i.stored_stats(), path, DAY)
    serving.refresh_history(i.spark, i.stored_stats(), path, RUN_DATE)
    return serving.read_history(i.spark, path)


@query("nightly_job", f"SELECT {_STATS} FROM stats WHERE event_date <= DATE '{DAY}'")
def nightly_job(i: Inputs) -> DataFrame:
    layout = jobs.Layout(i.scratch("nightly"))
    out.write_stats(_until(src.stats(i.spark, i.stored_stats()), BEFORE), layout.stats)
    serving.refresh_full(i.spark, layout.stats, layout.history)
    jobs.nightly(i.spark, i.pv, layout, RUN_DATE)
    return serving.serve(serving.read_history(i.spark, layout.history))


@query("hourly_job", f"SELECT {_STATS} FROM stats WHERE event_date = DATE '{RUN_DATE}'")
def hourly_job(i: Inputs) -> DataFrame:
    layout = jobs.Layout(i.scratch("hourly"))
    jobs.hourly(i.pv, layout, RUN_DATE)
    return src.stats_today(i.spark, layout.today, RUN_DATE)


@query("late_reprocess", f"SELECT {_STATS} FROM stats")
def late_reprocess(i: Inputs) -> DataFrame:
    path = i.scratch("late")
    out.write_stats(stats.daily_stats(_arrived(i, CUTOFF)), path)
    serving.reprocess(i.pv, CUTOFF, path)
    return src.stats(i.spark, path)


def _arrived(i: Inputs, moment: str) -> DataFrame:
    return i.pv.where(F.col("arrival_timestamp") < F.lit(moment).cast("timestamp"))


def _with_late_night(i: Inputs, label: str) -> jobs.Layout:
    """A table of what had arrived before the day, then one night that also takes the arrivals since."""
    layout = jobs.Layout(i.scratch(label))
    on_time, days = _arrived(i, str(DAY)), [r.event_date for r in i.pv.select("event_date").distinct().collect()]
    serving.recompute(on_time, [d for d in days if d < DAY], layout.stats, layout.events)
    serving.refresh_history(i.spark, layout.stats, layout.history, DAY)
    jobs.nightly(i.spark, i.pv, layout, RUN_DATE, since=str(DAY))
    return layout


@query("late_served", f"SELECT {_STATS} FROM stats WHERE event_date <= DATE '{DAY}'")
def late_served(i: Inputs) -> DataFrame:
    return serving.read_history(i.spark, _with_late_night(i, "late-served").history)


@query("late_events", f"SELECT {_EVENTS} FROM pv WHERE event_type = 'event' AND event_date <= DATE '{DAY}'")
def late_events(i: Inputs) -> DataFrame:
    return src.curated_events(i.spark, _with_late_night(i, "late-events").events)


@query("refresh_gap", f"SELECT {_STATS} FROM stats WHERE event_date <= DATE '{DAY}'")
def refresh_gap(i: Inputs) -> DataFrame:
    """Two nights were missed; the third refresh brings their days too."""
    path = i.scratch("gap")
    serving.refresh_full(i.spark, i.stored_stats(), path, DAY - dt.timedelta(days=2))
    serving.refresh_history(i.spark, i.stored_stats(), path, RUN_DATE, [DAY])
    return serving.read_history(i.spark, path)


@query("stats_by_difference", f"SELECT {_STATS} FROM stats")
def stats_by_difference(i: Inputs) -> DataFrame:
    """What arrives after a moment changes the sums of its visitors only."""
    root, views = i.scratch("ledger"), stats.pageviews
    on_time, late = views(_arrived(i, CUTOFF)), views(i.pv.where(F.col("arrival_timestamp") >= F.lit(CUTOFF).cast("timestamp")))
    ledger.add(partials.of(on_time), root, 0)
    ledger.add_late(on_time, late, root, 1)
    return ledger.table(i.spark, root)


@query("snapshot_reader", f"SELECT {_STATS} FROM stats WHERE event_date <= DATE '{BEFORE}'")
def snapshot_reader(i: Inputs) -> DataFrame:
    """The snapshot that a reader opened, read after a refresh that added a day and wrote another one again."""
    path = i.scratch("snapshots")
    serving.refresh_full(i.spark, i.stored_stats(), path, DAY)
    opened = serving.snapshot(i.spark, path).number
    serving.refresh_history(i.spark, i.stored_stats(), path, RUN_DATE, [BEFORE])
    return serving.read_history(i.spark, path, opened)


@query("registry_list", "SELECT domain_name, domain_key, created_timestamp FROM domains ORDER BY domain_name DESC")
def registry_list(i: Inputs) -> DataFrame:
    return registry.list_domains(i.domains)


@query("registry_get", f"SELECT domain_name, domain_key, created_timestamp FROM domains WHERE domain_name = '{DOMAIN}'")
def registry_get(i: Inputs) -> DataFrame:
    return registry.get_domain(i.domains, DOMAIN)


@query("registry_upsert", """
SELECT c_name AS domain_name, substr(sha256(concat('seed|', c_name)), 1, 16) AS domain_key,
  TIMESTAMP '2024-02-01 00:00:00' AS created_timestamp FROM customer
UNION ALL SELECT s_name, 'old', TIMESTAMP '2024-01-01 00:00:00' FROM supplier""")
def registry_upsert(i: Inputs) -> DataFrame:
    def named(table: str, column: str, key: str) -> DataFrame:
        return i.table(table).select(
            F.col(column).alias("domain_name"), F.lit(key).alias("domain_key"),
            F.lit("2024-01-01").cast("timestamp").alias("created_timestamp"))

    customers = named("customer", "c_name", "old")
    fresh = registry.new_keys(customers, "2024-02-01", seed="seed")
    return registry.upsert(customers.unionByName(named("supplier", "s_name", "old")), fresh)


@query("registry_upsert_repeated", """
SELECT c_name AS domain_name, concat('key', max(o_orderkey)) AS domain_key,
  TIMESTAMP '2024-02-01 00:00:00' AS created_timestamp
FROM (SELECT c_name, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY c_name) AS newest
  FROM customer JOIN orders ON c_custkey = o_custkey) o WHERE o_orderdate = newest GROUP BY c_name""")
def registry_upsert_repeated(i: Inputs) -> DataFrame:
    """Many changes of one domain: the newest counts, of equally new ones the largest key."""
    changes = i.table("customer").join(i.table("orders"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_name").alias("domain_name"), F.format_string("%012d", "o_orderkey").alias("domain_key"),
        F.col("o_orderdate").cast("timestamp").alias("created_timestamp"))
    old = changes.select("domain_name", F.lit("old").alias("domain_key"), F.lit("1990-01-01").cast("timestamp").alias(
        "created_timestamp")).distinct()
    return registry.upsert(old, changes).select(
        "domain_name", F.concat(F.lit("key"), F.col("domain_key").try_cast("bigint")).alias("domain_key"),
        F.lit("2024-02-01").cast("timestamp").alias("created_timestamp"))


@query("registry_delete", f"SELECT domain_name, domain_key, created_timestamp FROM domains WHERE domain_name <> '{DOMAIN}'")
def registry_delete(i: Inputs) -> DataFrame:
    gone = registry.get_domain(i.domains, DOMAIN).select("domain_name")
    return registry.delete(i.domains, gone)


# Six customers change the registry at one moment: two for each of three domains.
_SETTLED = """(SELECT concat('site', c_custkey % 3, '.example') AS domain_name,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(97 * CAST(c_custkey // 6 AS BIGINT)) AS changed_at,
    max(CASE WHEN c_custkey % 7 > 1 THEN concat('k', c_custkey // 3 % 4) END) AS domain_key
  FROM customer GROUP BY ALL) c"""
_INTERVALS = f"""(SELECT domain_name, domain_key, changed_at AS valid_from,
    lead(changed_at) OVER (PARTITION BY domain_name ORDER BY changed_at) AS valid_to FROM {_SETTLED}) i"""
_KEYED = "(SELECT *, concat('k', CAST(substr(page_view_id, 3) AS BIGINT) % 4) AS domain_key FROM pv) p"
_THEN = f"""FROM {_KEYED} LEFT JOIN {_INTERVALS} ON i.domain_name = p.domain_name AND i.valid_from <= p.event_timestamp
  AND (i.valid_to IS NULL OR p.event_timestamp < i.valid_to)"""


def _changes(i: Inputs) -> DataFrame:
    key = F.col("c_custkey").cast("bigint")
    return i.table("customer").select(
        F.concat(F.lit("site"), key % 3, F.lit(".example")).alias("domain_name"),
        F.concat(F.lit("k"), F.floor(key / 3) % 4).alias("domain_key"),
        F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + 97 * 60 * F.floor(key / 6)).alias("changed_at"),
        (key % 7 <= 1).alias("deleted"))


def _with_keys(i: Inputs) -> DataFrame:
    return i.pv.withColumn("domain_key", F.concat(F.lit("k"), F.substring("page_view_id", 3, 20).cast("bigint") % 4))


@query("registry_intervals", f"SELECT domain_name, domain_key, valid_from, valid_to FROM {_INTERVALS} WHERE domain_key IS NOT NULL")
def registry_intervals(i: Inputs) -> DataFrame:
    return timeline.intervals(_changes(i))


@query("registry_verified_then", f"SELECT p.page_view_id, p.domain_name, p.domain_key {_THEN} WHERE i.domain_key = p.domain_key")
def registry_verified_then(i: Inputs) -> DataFrame:
    return timeline.verified_then(_with_keys(i), _changes(i)).select("page_view_id", "domain_name", "domain_key")


@query("registry_unverified_then", f"""
SELECT p.page_view_id, p.domain_name, i.domain_key AS key_then {_THEN} WHERE i.domain_key IS DISTINCT FROM p.domain_key""")
def registry_unverified_then(i: Inputs) -> DataFrame:
    return timeline.unverified_then(_with_keys(i), _changes(i)).select("page_view_id", "domain_name", "key_then")


@query("visitors_of_range", """
SELECT domain_name, browser_name, count(DISTINCT daily_visitor_id) AS visitors_exact, true AS within_bounds
FROM views WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY domain_name, browser_name""")
def visitors_of_range(i: Inputs) -> DataFrame:
    """Sketches of the page views that came in time, those of late ones added, against the exact number."""
    path, late = i.scratch("sketches"), F.col("arrival_timestamp") > F.col("event_timestamp") + F.expr("INTERVAL 36 HOURS")
    views = i.pv.where("event_type = 'pageview'")
    distincts.sketches(views.where(~late)).write.partitionBy("event_date").parquet(path)
    stored = distincts.added(i.spark.read.parquet(path), views)
    by, first, last = ["domain_name", "browser_name"], "2024-01-01", "2024-01-30"
    found = distincts.between(stored, first, last, by)
    exact = views.where(F.col("event_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(*by).agg(
        F.count_distinct("daily_visitor_id").alias("visitors_exact")).select(*[F.col(c).alias(f"x_{c}") for c in by], "visitors_exact")
    same = found["domain_name"].eqNullSafe(exact["x_domain_name"]) & found["browser_name"].eqNullSafe(exact["x_browser_name"])
    inside = F.col("visitors_exact").between(F.col("visitors_low"), F.col("visitors_high"))
    return found.join(exact, same).select(*by, "visitors_exact", inside.alias("within_bounds"))


@query("src_object_notifications", "SELECT event_name, event_time, s3_bucket, s3_key, file_size FROM object_events")
def src_object_notifications(i: Inputs) -> DataFrame:
    rows = read_notifications(i.notifications)
    return manifest.parse_keys(rows).select("event_name", "event_time", "s3_bucket", "s3_key", "file_size")


_KEYS = """
SELECT s3_key, event_time, file_size, CASE WHEN s3_key LIKE 'incoming/%' THEN 'cleaned' ELSE 'curated' END AS file_type,
  CASE WHEN s3_key LIKE 'incoming/%' THEN 'pageview' ELSE split_part(s3_key, '/', 2) END AS file_sub_type,
  nullif(regexp_extract(s3_key, 'domain_name=([^/]*)', 1), '') AS file_domain_name,
  CAST(regexp_extract(s3_key, 'event_date=([^/]*)', 1) AS DATE) AS file_event_date,
  CAST(nullif(regexp_extract(s3_key, 'event_hour=([^/]*)', 1), '') AS INT) AS file_event_hour,
  regexp_extract(s3_key, '([^/]*)$', 1) AS file_name"""


@query("manifest_parse_keys", f"{_KEYS} FROM object_events")
def manifest_parse_keys(i: Inputs) -> DataFrame:
    return manifest.parse_keys(i.object_events).select(
        "s3_key", "event_time", "file_size", "file_type", "file_sub_type", "file_domain_name", "file_event_date",
        "file_event_hour", "file_name")


_CURRENT = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s3_key ORDER BY event_time DESC) AS rn
  FROM object_events) n WHERE rn = 1 AND event_name LIKE 'ObjectCreated%') c"""


@query("manifest_current", f"{_KEYS.replace('event_time,', 'event_time AS file_created_timestamp,')} FROM {_CURRENT}")
def manifest_current(i: Inputs) -> DataFrame:
    return manifest.current_files(read_notifications(i.notifications)).select(
        "s3_key", "file_created_timestamp", "file_size", "file_type", "file_sub_type", "file_domain_name",
        "file_event_date", "file_event_hour", "file_name")


@query("manifest_list_files", f"""
SELECT s3_key, file_size FROM {_CURRENT}
WHERE s3_key LIKE 'aggregated/daily-stats/event_date={DAY}%'""")
def manifest_list_files(i: Inputs) -> DataFrame:
    files = manifest.current_files(i.object_events)
    return manifest.list_files(files, DAY, manifest.today_prefix(DAY)).select("s3_key", "file_size")


@query("today_changed", f"""
SELECT count(*) AS file_count, count(*) <> (SELECT count(*) FROM
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s3_key ORDER BY event_time DESC) AS rn
    FROM object_events WHERE event_time < TIMESTAMP '{DAY} 12:00:00') n
   WHERE rn = 1 AND event_name LIKE 'ObjectCreated%') b
  WHERE s3_key LIKE 'aggregated/daily-stats/event_date={DAY}%') AS changed
FROM {_CURRENT} WHERE s3_key LIKE 'aggregated/daily-stats/event_date={DAY}%'""")
def today_changed(i: Inputs) -> DataFrame:
    noon = F.lit(f"{DAY} 12:00:00").cast("timestamp")
    earlier = manifest.current_files(i.object_events.where(F.col("event_time") < noon))
    last = manifest.files_today(earlier, DAY).select("file_count").scalar()
    return manifest.files_today(manifest.current_files(i.object_events), DAY).select(
        "file_count", (F.col("file_count") != last).alias("changed"))


@query("today_replaced", f"""
SELECT n.file_count, n.file_count <> b.file_count OR n.newest <> b.newest AS changed
FROM (SELECT count(*) AS file_count, max(event_time) AS newest FROM {_CURRENT}
    WHERE s3_key LIKE 'aggregated/daily-stats/event_date={DAY}%') n,
  (SELECT count(*) AS file_count, max(event_time) AS newest FROM
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s3_key ORDER BY event_time DESC) AS rn
      FROM object_events WHERE event_time < TIMESTAMP '{DAY} 12:00:00') o
     WHERE rn = 1 AND event_name LIKE 'ObjectCreated%') e
    WHERE s3_key LIKE 'aggregated/daily-stats/event_date={DAY}%') b""")
def today_replaced(i: Inputs) -> DataFrame:
    """Files that were replaced one for one are noticed by the time of the newest."""
    noon = F.lit(f"{DAY} 12:00:00").cast("timestamp")
    earlier = manifest.files_today(manifest.current_files(i.object_events.where(F.col("event_time") < noon)), DAY)
    changed = (F.col("file_count") != earlier.select("file_count").scalar()) | (
        F.col("newest_file") != earlier.select("newest_file").scalar())
    return manifest.files_today(manifest.current_files(i.object_events), DAY).select("file_count", changed.alias("changed"))

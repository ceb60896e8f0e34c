"""Page views, log lines and dimensions derived from the test tables.

The texts are plain SELECTs that Spark and the checking engine both read. ``{sec}``
and ``{ms}`` stand for whole seconds and milliseconds of ``ts``.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import stats as stat_ops
from footfall.operators.dates import Period
from footfall.session import configure, scratch
from footfall.sinks import tables as out
from footfall.sources.access_log import spread

DOMAIN = "site0.example"
DAY = dt.date(2024, 1, 15)
RUN_DATE = dt.date(2024, 1, 16)
FORTNIGHT = Period(dt.date(2024, 1, 16), dt.date(2024, 1, 30), dt.date(2024, 1, 1), dt.date(2024, 1, 15), "daily")

VISITORS = "SELECT *, CAST(floor(user_id / 16.0) AS BIGINT) AS v FROM {events}"

PV = """
SELECT concat('site', CAST(v % 3 AS STRING), '.example') AS domain_name,
  CAST(ts AS DATE) AS event_date, ts AS event_timestamp,
  CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL '1' DAY ELSE ts + INTERVAL '2' DAY END
    AS arrival_timestamp,
  CASE WHEN event_type IN ('signup', 'error') THEN 'event' ELSE 'pageview' END AS event_type,
  CASE WHEN event_type IN ('signup', 'error') THEN event_type END AS event_name,
  CASE WHEN event_type IN ('signup', 'error') THEN props END AS event_data,
  md5(concat(CAST(v AS STRING), '|', CAST(CAST(ts AS DATE) AS STRING))) AS daily_visitor_id,
  concat('pv', CAST(event_id AS STRING)) AS page_view_id,
  concat('/p/', CAST(event_id % 12 AS STRING)) AS request_path,
  CASE event_id % 5 WHEN 0 THEN 'search.example' WHEN 1 THEN 'social.example'
    ELSE 'Direct / None' END AS referrer_domain_name,
  CASE v % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' END AS browser_name,
  CASE v % 3 WHEN 0 THEN 'Mac OS' WHEN 1 THEN 'Windows' END AS browser_os_name,
  CASE v % 5 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Tablet' ELSE 'Desktop' END AS device_type,
  CASE WHEN v % 2 = 0 THEN 'Apple' END AS device_vendor,
  n_name AS edge_country, concat('CITY_', CAST(v % 7 AS STRING)) AS edge_city,
  CAST(v % 90 AS FLOAT) AS edge_latitude, CAST(v % 180 AS FLOAT) AS edge_longitude,
  CASE WHEN event_id % 6 = 0 THEN 'newsletter' END AS utm_source,
  CASE WHEN event_id % 6 = 0 THEN 'spring' END AS utm_campaign,
  CASE WHEN event_id % 6 = 0 THEN 'email' END AS utm_medium,
  CAST(NULL AS STRING) AS utm_content, CAST(NULL AS STRING) AS utm_term
FROM {visitors} e LEFT JOIN {nation} n ON n_nationkey = v % 25
"""

# Percent-encoded user agents as the log holds them.
_AGENTS = {
    0: "Mozilla/5.0%20(Macintosh;%20Intel%20Mac%20OS%20X%2010_15_7)%20AppleWebKit/537.36"
       "%20(KHTML,%20like%20Gecko)%20Chrome/107.0.0.0%20Safari/537.36",
    1: "Mozilla/5.0%20(Windows%20NT%2010.0;%20Win64;%20x64;%20rv:115.0)%20Gecko/20100101%20Firefox/115.0",
    2: "Mozilla/5.0%20(iPhone;%20CPU%20iPhone%20OS%2017_1%20like%20Mac%20OS%20X)%20AppleWebKit/605.1.15"
       "%20(KHTML,%20like%20Gecko)%20Version/17.1%20Mobile/15E148%20Safari/604.1",
    3: "Mozilla/5.0%20(Linux;%20Android%2013;%20SM-S901B)%20AppleWebKit/537.36"
       "%20(KHTML,%20like%20Gecko)%20Chrome/112.0.0.0%20Mobile%20Safari/537.36",
}
_AGENT = "CASE WHEN event_id % 31 = 0 THEN 'ExampleBot/1.0' ELSE CASE v % 4 " + " ".join(
    f"WHEN {k} THEN '{text}'" for k, text in _AGENTS.items()) + " END END"

# Log lines with every kind of fault: short lines, foreign paths, script-less hits,
# broken escapes, unreadable times, bad referrers and wrong keys.
RAW_LOG = """
SELECT concat(CAST({sec} AS STRING), '.38', chr(9), '198.51.100.', CAST(v % 250 AS STRING), chr(9),
  CASE WHEN event_id % 13 = 0 THEN '304' ELSE '200' END, chr(9),
  CASE WHEN event_id % 20 = 0 THEN '/go.js' WHEN event_id % 23 = 0 THEN '/noscript.gif?n=1'
    ELSE '/hello.gif?n=1' END, chr(9),
  CAST(100 + event_id % 900 AS STRING), chr(9),
  CASE v % 3 WHEN 0 THEN 'HAM50-P2' WHEN 1 THEN 'SFO53-C1' ELSE 'ZZZ1-C1' END, chr(9),
  '0.0', CAST(10 + event_id % 90 AS STRING), chr(9), {agent}, chr(9),
  'https://www.site', CAST(v % 3 AS STRING), '.example/p/', CAST(event_id % 12 AS STRING), chr(9),
  CASE WHEN event_id % 23 = 0 THEN concat('t=pv&dk=key', CAST(v % 3 AS STRING)) ELSE concat(
    't=', CASE WHEN event_type IN ('signup', 'error') THEN 'tr' ELSE 'pv' END,
    '&ts=', CASE WHEN event_id % 43 = 0 THEN 'soon' ELSE CAST({ms} AS STRING) END,
    '&u=https%253A%252F%252Fsite', CAST(v % 3 AS STRING), '.example%252Fp%252F', CAST(event_id % 12 AS STRING),
    '&hn=site', CAST(v % 3 AS STRING), '.example&pa=%252Fp%252F', CAST(event_id % 12 AS STRING),
    '&dk=', CASE WHEN event_id % 17 = 0 THEN 'wrong' ELSE concat('key', CAST(v % 3 AS STRING)) END,
    CASE WHEN event_id % 6 = 0 THEN '&uso=newsletter&uca=spring%252B24&ume=e+mail' ELSE '' END,
    CASE WHEN event_id % 47 = 0 THEN '&r=elsewhere' WHEN event_id % 5 = 0 THEN
      '&r=https%253A%252F%252FSearch.example%252Fq%253Futm_source%253Dads%2526utm_term%253Dred%252520shoes'
      WHEN event_id % 5 = 1 THEN concat('&r=https%253A%252F%252Fsite', CAST(v % 3 AS STRING), '.example%252F')
      ELSE '' END,
    CASE WHEN event_id % 3 = 0 THEN '&iw=1356' ELSE '&iw=1356&ih=902' END,
    '&w=', CAST(1000 + v % 500 AS STRING), '&h=1440&d=24&p=MacIntel&m=8&tz=Europe%252FBerlin',
    CASE WHEN event_id % 4 = 0 THEN '&c=' ELSE concat('&c=', CAST(1 + v % 16 AS STRING)) END,
    CASE WHEN event_id % 37 = 0 THEN '&l=%25zz' ELSE '&l=de-DE' END,
    CASE WHEN event_type IN ('signup', 'error') THEN concat('&en=', event_type, '&pr=',
      replace(replace(replace(replace(replace(props, chr(123), '%257B'), chr(125), '%257D'),
        chr(34), '%2522'), ':', '%253A'), ' ', '%2520')) ELSE '' END,
    CASE WHEN event_id % 7 = 0 THEN '&t=zz&pa=%252Fother' ELSE '' END) END,
  chr(9), 'Hit', CASE WHEN event_id % 41 = 0 THEN '' ELSE concat(chr(9), '3320') END) AS value
FROM {visitors} e
""".replace("{agent}", _AGENT)

DOMAINS = """
SELECT concat('site', CAST(n_nationkey AS STRING), '.example') AS domain_name,
  concat('key', CAST(n_nationkey AS STRING)) AS domain_key,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + n_nationkey * INTERVAL '1' DAY AS created_timestamp
FROM {nation} n WHERE n_nationkey < 3
"""

EDGES = """
SELECT CASE n_nationkey WHEN 0 THEN 'HAM' ELSE 'SFO' END AS edge_id, concat('CITY_', n_name) AS city,
  concat('STATE_', n_name) AS state, n_name AS country, concat('N', CAST(n_nationkey AS STRING)) AS country_code,
  CAST(n_nationkey AS FLOAT) AS latitude, CAST(-n_nationkey AS FLOAT) AS longitude
FROM {nation} n WHERE n_nationkey < 2
"""

COUNTRIES = """
SELECT n_name AS country, concat('n', CAST(n_nationkey AS STRING)) AS country_code
FROM {nation} n WHERE n_regionkey <> 4
"""

# One date has no salt.
SALTS = """
SELECT DISTINCT CAST(ts AS DATE) AS event_date, md5(CAST(CAST(ts AS DATE) AS STRING)) AS salt
FROM {events} e WHERE CAST(ts AS DATE) <> DATE '2024-01-07'
"""

OBJECT_EVENTS = """
SELECT ts AS event_time,
  CASE WHEN event_id % 4 = 3 THEN 'ObjectRemoved:Delete' ELSE 'ObjectCreated:Put' END AS event_name,
  'store' AS s3_bucket,
  CASE event_id % 3
    WHEN 0 THEN concat('incoming/domain_name=site', CAST(user_id % 3 AS STRING),
      '.example/event_type=pageview/event_date=', CAST(CAST(ts AS DATE) AS STRING),
      '/part-', CAST(event_id % 5 AS STRING), '.parquet')
    WHEN 1 THEN concat('aggregated/stats/domain_name=site', CAST(user_id % 3 AS STRING),
      '.example/event_date=', CAST(CAST(ts AS DATE) AS STRING), '/data_0.parquet')
    ELSE concat('aggregated/daily-stats/event_date=', CAST(CAST(ts AS DATE) AS STRING),
      '/event_hour=', CAST(hour(ts) AS STRING), '/stats_0.parquet') END AS s3_key,
  1000 + event_id AS file_size
FROM {events} e
"""

SPARK_TIME = {"{sec}": "unix_timestamp(ts)", "{ms}": "unix_millis(ts)"}

_stored: dict[tuple, str] = {}


class Inputs:
    """The derived tables of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def run(self, text: str, **tables: DataFrame) -> DataFrame:
        for mark, expression in SPARK_TIME.items():
            text = text.replace(mark, expression)
        given = {"events": self.events, **tables}
        given["visitors"] = self.spark.sql(VISITORS, events=given["events"])
        given["nation"] = self.table("nation")
        used = {name: df for name, df in given.items() if f"{{{name}}}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def events(self) -> DataFrame:
        events = self.table("events")
        return events.withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def pv(self) -> DataFrame:
        return self.run(PV)

    @cached_property
    def views(self) -> DataFrame:
        return stat_ops.pageviews(self.pv)

    @cached_property
    def raw_log(self) -> DataFrame:
        return spread(self._lines(self.run(RAW_LOG)))

    @staticmethod
    def _lines(made: DataFrame) -> DataFrame:
        """Lines as a scan would give them: built once, not once per use."""
        return made.select(F.explode(F.array("value")).alias("value"))

    @cached_property
    def domains(self) -> DataFrame:
        return self.run(DOMAINS)

    @cached_property
    def edges(self) -> DataFrame:
        return self.run(EDGES)

    @cached_property
    def countries(self) -> DataFrame:
        return self.run(COUNTRIES)

    @cached_property
    def salts(self) -> DataFrame:
        return self.run(SALTS)

    @cached_property
    def object_events(self) -> DataFrame:
        return self.run(OBJECT_EVENTS)

    @cached_property
    def notifications(self) -> DataFrame:
        return self._enveloped(self.object_events)

    def notification_stream(self) -> DataFrame:
        return self._enveloped(self.run(OBJECT_EVENTS, events=self.event_stream()))

    @staticmethod
    def _enveloped(object_events: DataFrame) -> DataFrame:
        """The object events inside message envelopes."""
        when = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        record = F.struct(
            F.col("event_name").alias("eventName"), when.alias("eventTime"),
            F.struct(F.struct(F.col("s3_bucket").alias("name")).alias("bucket"),
                     F.struct(F.replace("s3_key", F.lit("="), F.lit("%3D")).alias("key"),
                              F.col("file_size").alias("size")).alias("object")).alias("s3"))
        message = F.to_json(F.struct(F.array(record).alias("Records")))
        envelope = F.struct(F.struct(message.alias("Message")).alias("Sns"))
        return object_events.select(F.to_json(F.struct(F.array(envelope).alias("Records"))).alias("value"))

    @cached_property
    def stats(self) -> DataFrame:
        return stat_ops.hourly_stats(self.views)

    def scratch(self, label: str) -> str:
        return scratch(self.spark, label)

    def stored_stats(self) -> str:
        """Folder of the statistics table, written once per application."""
        key = (self.spark.sparkContext.applicationId, self.dir, "stats")
        if key not in _stored:
            path = self.scratch("stats")
            out.write_stats(self.stats, path)
            _stored[key] = path
        return _stored[key]

    def event_stream(self) -> DataFrame:
        """The events table as a stream; the pattern also matches a folder of files."""
        raw = self.spark.readStream.schema(self.table("events").schema).parquet(f"{self.dir}/events.parque[t]")
        return raw.withColumn("ts", F.col("ts").cast("timestamp"))

    def pv_stream(self) -> DataFrame:
        return self.run(PV, events=self.event_stream())

    def raw_stream(self) -> DataFrame:
        return self._lines(self.run(RAW_LOG, events=self.event_stream()))


def _own(text: str) -> str:
    """The checking engine's reading of an input text."""
    text = text.replace("{sec}", "CAST(floor(epoch(ts)) AS BIGINT)").replace("{ms}", "(epoch_us(ts) // 1000)")
    return re.sub(r"\{(\w+)\}", r"\1", text)


# The same inputs for the checking engine, plus what the log lines say and the
# sessions and statistics defined by plain windows and joins.
CHECK_TABLES: dict[str, str] = {
    "visitors": _own(VISITORS),
    "pv": _own(PV),
    "views": "SELECT * FROM pv WHERE event_type = 'pageview'",
    "raw_log": _own(RAW_LOG),
    "domains": _own(DOMAINS),
    "edges": _own(EDGES),
    "countries": _own(COUNTRIES),
    "salts": _own(SALTS),
    "object_events": _own(OBJECT_EVENTS),
    "log_truth": """
SELECT e.*, s.salt, make_timestamp(epoch_us(ts) // 1000 * 1000) AS event_timestamp,
  make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS arrival_timestamp,
  CAST(ts AS DATE) AS event_date, concat('site', v % 3, '.example') AS domain_name,
  concat('/p/', event_id % 12) AS request_path, concat('198.51.100.', v % 250) AS ip,
  replace(AGENT, '%20', ' ') AS agent,
  event_type IN ('signup', 'error') AS is_event,
  CASE WHEN event_id % 5 = 0 THEN
    'https://Search.example/q?utm_source=ads&utm_term=red%20shoes' END AS referrer,
  CASE WHEN event_id % 41 = 0 THEN 'arity' WHEN event_id % 20 = 0 THEN 'path'
    WHEN event_id % 37 = 0 AND event_id % 23 <> 0 THEN 'encoding'
    WHEN event_id % 43 = 0 OR event_id % 23 = 0 THEN 'timestamp'
    WHEN event_id % 47 = 0 THEN 'referrer' END AS hit_error,
  CASE WHEN event_id % 17 = 0 THEN 'unverified' WHEN s.salt IS NULL THEN 'no_salt' END AS later_error
FROM visitors e LEFT JOIN salts s ON s.event_date = CAST(ts AS DATE)
""".replace("AGENT", _AGENT),
    "hits": "SELECT * FROM log_truth WHERE hit_error IS NULL",
    "sessions": """
WITH b AS (SELECT *, CAST(floor(epoch(event_timestamp)) AS BIGINT) AS sec,
    lag(CAST(floor(epoch(event_timestamp)) AS BIGINT)) OVER (PARTITION BY domain_name, event_date, daily_visitor_id
      ORDER BY event_timestamp, page_view_id) AS psec FROM views),
  m AS (SELECT *, sum(CASE WHEN psec IS NULL OR sec - psec > 1800 THEN 1 ELSE 0 END) OVER (
    PARTITION BY domain_name, event_date, daily_visitor_id ORDER BY event_timestamp, page_view_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM b)
SELECT domain_name, event_date, daily_visitor_id, CAST(sid AS BIGINT) AS session_no,
  min_by(page_view_id, event_timestamp) AS first_page_view_id,
  min(event_timestamp) AS session_start, max(event_timestamp) AS session_end,
  CAST(max(sec) - min(sec) AS BIGINT) AS visit_duration_sec, count(*) AS n_views,
  CAST(CASE WHEN min(event_timestamp) = max(event_timestamp) THEN 1 ELSE 0 END AS INT) AS is_bounce
FROM m GROUP BY domain_name, event_date, daily_visitor_id, sid
""",
    # Start and end rows, and the visit label they carry.
    "boundary": """
WITH b AS (SELECT domain_name, event_date, daily_visitor_id, event_timestamp, page_view_id,
    md5(concat(daily_visitor_id, '|', epoch_us(event_timestamp), '|', page_view_id)) AS own,
    lag(event_timestamp, 1, event_timestamp) OVER w AS before, lead(event_timestamp, 1, event_timestamp) OVER w AS after
  FROM views WINDOW w AS (PARTITION BY domain_name, event_date, daily_visitor_id
    ORDER BY event_timestamp, page_view_id)),
  f AS (SELECT *, CAST(floor(epoch(event_timestamp)) - floor(epoch(before)) AS BIGINT) > 1800
      OR event_timestamp = before AS is_session_start,
    CAST(floor(epoch(after)) - floor(epoch(event_timestamp)) AS BIGINT) > 1800
      OR event_timestamp = after AS is_session_end FROM b)
SELECT *, CASE WHEN is_session_end THEN lag(own, 1, own) OVER (PARTITION BY domain_name, event_date, daily_visitor_id
    ORDER BY event_timestamp, page_view_id) ELSE own END AS label
FROM f WHERE is_session_start OR is_session_end
""",
    "boundary_sessions": """
SELECT domain_name, event_date, daily_visitor_id, label AS unique_daily_visitor_id,
  min_by(page_view_id, event_timestamp) AS first_page_view_id,
  min(event_timestamp) AS session_start, max(event_timestamp) AS session_end,
  CAST(floor(epoch(max(event_timestamp))) - floor(epoch(min(event_timestamp))) AS BIGINT) AS visit_duration_sec
FROM boundary GROUP BY domain_name, event_date, daily_visitor_id, label
""",
}

_STATS = """
SELECT DIMS, CAST(count(page_view_id) AS INT) AS page_views_cnt,
  CAST(count(DISTINCT sid) AS INT) AS visitor_cnt,
  CAST(count(DISTINCT CASE WHEN single THEN sid END) AS INT) AS bounce_cnt,
  CAST(coalesce(round(avg(visit_duration_sec), 0), 0) AS INT) AS visit_duration_sec_avg
FROM (SELECT p.*, CAST(hour(p.event_timestamp) AS INT) AS event_hour, s.sid, s.single, s.visit_duration_sec
  FROM views p LEFT JOIN (SOURCE) s
    ON p.daily_visitor_id = s.daily_visitor_id AND p.page_view_id = s.first_page_view_id) j
GROUP BY DIMS
""".replace("DIMS", ", ".join(schemas.DIMS))

CHECK_TABLES["stats"] = _STATS.replace("SOURCE", """
SELECT *, concat(daily_visitor_id, '|', session_no) AS sid, is_bounce = 1 AS single FROM sessions""")
CHECK_TABLES["boundary_stats"] = _STATS.replace("SOURCE", """
SELECT *, unique_daily_visitor_id AS sid, session_start = session_end AS single FROM boundary_sessions""")


def check_sql(body: str) -> str:
    """A complete statement: the body behind the input definitions it mentions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in CHECK_TABLES and name not in order:
                visit(CHECK_TABLES[name])
                order.append(name)

    visit(body)
    head = ",\n".join(f"{name} AS ({CHECK_TABLES[name].strip()})" for name in order)
    return f"WITH {head}\n{body.strip()}" if head else body.strip()

"""Log lines: scanning, parsing, enriching, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.catalog.book import query
from footfall.catalog.inputs import Inputs
from footfall.functions import agents, urls
from footfall.operators import dictionary, dimensions, parsing, stats
from footfall.session import scratch

_FIELD = ",\n  ".join(f"string_split(value, chr(9))[{i + 1}] AS {name}" for i, name in enumerate(parsing.FIELDS))


def _hits(i: Inputs) -> DataFrame:
    return parsing.read_hits(i.raw_log).where(F.col("error").isNull())


@query("src_access_log", f"SELECT value, CAST(len(string_split(value, chr(9))) AS INT) AS field_count, {_FIELD} FROM raw_log")
def src_access_log(i: Inputs) -> DataFrame:
    from footfall.sources.access_log import unwrap

    wrapped = i.raw_log.select(F.base64(F.encode("value", "UTF-8")).alias("data"))
    return parsing.split_fields(unwrap(wrapped))


@query("parse_arity", "SELECT value FROM raw_log WHERE len(string_split(value, chr(9))) = 12")
def parse_arity(i: Inputs) -> DataFrame:
    return parsing.split_fields(i.raw_log).where(F.col("field_count") == len(parsing.FIELDS)).select("value")


@query("parse_path_filter", """
SELECT value, string_split(value, chr(9))[4] LIKE '%/noscript.gif%' AS is_noscript
FROM raw_log WHERE len(string_split(value, chr(9))) = 12
  AND (string_split(value, chr(9))[4] LIKE '/hello.gif%' OR string_split(value, chr(9))[4] LIKE '/noscript.gif%')""")
def parse_path_filter(i: Inputs) -> DataFrame:
    return parsing.gate(parsing.split_fields(i.raw_log)).where("error is null").select("value", "is_noscript")


@query("parse_query_string", """
SELECT CASE WHEN is_event THEN 'tr' ELSE 'pv' END AS type, request_path AS path,
  CASE WHEN event_id % 6 = 0 THEN 'spring+24' END AS campaign,
  CASE WHEN event_id % 6 = 0 THEN 'e mail' END AS medium,
  CASE WHEN event_id % 4 <> 0 THEN CAST(1 + v % 16 AS STRING) END AS cores,
  CASE WHEN event_id % 37 <> 0 THEN 'de-DE' END AS language
FROM log_truth WHERE event_id % 41 <> 0 AND event_id % 20 <> 0 AND event_id % 23 <> 0""")
def parse_query_string(i: Inputs) -> DataFrame:
    hits = parsing.with_params(parsing.gate(parsing.split_fields(i.raw_log)))
    return hits.where("error is null and not is_noscript").select(
        parsing.param("type").alias("type"), parsing.param("path").alias("path"),
        parsing.param("utm_campaign").alias("campaign"), parsing.param("utm_medium").alias("medium"),
        parsing.param("cores").alias("cores"), parsing.param("language").alias("language"))


@query("parse_timestamps", """
SELECT event_timestamp, arrival_timestamp, event_date, CAST(year(event_date) AS INT) AS event_year,
  CAST(month(event_date) AS INT) AS event_month, CAST(day(event_date) AS INT) AS event_day,
  CAST((epoch_us(event_timestamp) - epoch_us(arrival_timestamp)) // 1000 AS BIGINT) AS arrival_delay_ms FROM hits""")
def parse_timestamps(i: Inputs) -> DataFrame:
    return _hits(i).select("event_timestamp", "arrival_timestamp", "event_date", "event_year", "event_month",
                           "event_day", "arrival_delay_ms")


@query("parse_request_fields", """
SELECT request_path, CAST(100 + event_id % 900 AS BIGINT) AS request_bytes,
  CAST(CASE WHEN event_id % 13 = 0 THEN 304 ELSE 200 END AS INT) AS request_status_code,
  'Hit' AS request_cache_status, CAST(10 + event_id % 90 AS BIGINT) AS request_delivery_time_ms,
  CAST(3320 AS BIGINT) AS request_asn FROM hits""")
def parse_request_fields(i: Inputs) -> DataFrame:
    return _hits(i).select("request_path", "request_bytes", "request_status_code", "request_cache_status",
                           "request_delivery_time_ms", "request_asn")


@query("parse_url_path", """
SELECT event_timestamp, concat('https://', domain_name, request_path) AS request_url, request_path, FALSE AS is_noscript
FROM hits UNION ALL
SELECT arrival_timestamp, concat('https://www.', domain_name, request_path), '/noscript.gif', TRUE
FROM log_truth WHERE event_id % 23 = 0 AND event_id % 41 <> 0 AND event_id % 20 <> 0""")
def parse_url_path(i: Inputs) -> DataFrame:
    hits = parsing.read_hits(i.raw_log, noscript_fallback=True).where("error is null")
    return hits.select("event_timestamp", "request_url", "request_path", "is_noscript")


@query("parse_referrer", """
SELECT event_timestamp, referrer, CASE WHEN referrer IS NULL THEN 'Direct / None' ELSE 'search.example' END
  AS referrer_domain_name FROM hits""")
def parse_referrer(i: Inputs) -> DataFrame:
    return _hits(i).select("event_timestamp", "referrer", "referrer_domain_name")


@query("parse_utm", """
SELECT event_timestamp,
  CASE WHEN event_id % 6 = 0 THEN 'newsletter' WHEN event_id % 5 = 0 THEN 'ads' END AS utm_source,
  CASE WHEN event_id % 6 = 0 THEN 'spring+24' END AS utm_campaign,
  CASE WHEN event_id % 6 = 0 THEN 'e mail' END AS utm_medium, CAST(NULL AS STRING) AS utm_content,
  CASE WHEN event_id % 5 = 0 THEN 'red shoes' END AS utm_term FROM hits""")
def parse_utm(i: Inputs) -> DataFrame:
    return _hits(i).select("event_timestamp", *parsing.UTM)


@query("parse_client_fields", """
SELECT event_timestamp, 'Europe/Berlin' AS browser_timezone, 'de-DE' AS browser_language,
  concat(1000 + v % 500, 'x1440') AS device_outer_resolution,
  CASE WHEN event_id % 3 <> 0 THEN '1356x902' END AS device_inner_resolution,
  CAST(24 AS INT) AS device_color_depth, 'MacIntel' AS device_platform, CAST(8 AS FLOAT) AS device_memory,
  CAST(CASE WHEN event_id % 4 <> 0 THEN 1 + v % 16 END AS INT) AS device_cores FROM hits""")
def parse_client_fields(i: Inputs) -> DataFrame:
    return _hits(i).select(
        "event_timestamp", "browser_timezone", "browser_language", "device_outer_resolution",
        "device_inner_resolution", "device_color_depth", "device_platform", "device_memory", "device_cores")


_HUMAN = "event_id % 31 <> 0"


@query("enrich_user_agent", f"""
SELECT event_timestamp,
  CASE WHEN {_HUMAN} THEN CASE v % 4 WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Mobile Safari' ELSE 'Chrome' END END
    AS browser_name,
  CASE WHEN {_HUMAN} THEN CASE v % 4 WHEN 0 THEN '107.0.0.0' WHEN 1 THEN '115.0' WHEN 2 THEN '17.1'
    ELSE '112.0.0.0' END END AS browser_version,
  CASE WHEN {_HUMAN} THEN CASE v % 4 WHEN 0 THEN 'Mac OS' WHEN 1 THEN 'Windows' WHEN 2 THEN 'iOS'
    ELSE 'Android' END END AS browser_os_name,
  CASE WHEN {_HUMAN} THEN CASE v % 4 WHEN 0 THEN '10.15.7' WHEN 1 THEN '10' WHEN 2 THEN '17.1'
    ELSE '13' END END AS browser_os_version,
  CASE WHEN {_HUMAN} THEN CASE v % 4 WHEN 0 THEN 'Apple' WHEN 2 THEN 'Apple' WHEN 3 THEN 'Samsung' END END
    AS device_vendor FROM hits""")
def enrich_user_agent(i: Inputs) -> DataFrame:
    return _hits(i).select("event_timestamp", "browser_name", "browser_version", "browser_os_name",
                           "browser_os_version", "device_vendor")


@query("enrich_own_rules", f"""
SELECT event_timestamp, CASE WHEN {_HUMAN} THEN CASE v % 4 WHEN 1 THEN 'Fox' ELSE 'Webkit' END END AS browser_name,
  CASE WHEN {_HUMAN} THEN CASE v % 4 WHEN 0 THEN '537.36' WHEN 2 THEN '604.1' WHEN 3 THEN '537.36' END END AS browser_version,
  CASE WHEN {_HUMAN} AND v % 4 = 3 THEN 'Droid' END AS browser_os_name,
  CAST(CASE WHEN {_HUMAN} AND v % 4 = 1 THEN 1 ELSE 0 END AS INT) AS request_is_bot FROM hits""")
def enrich_own_rules(i: Inputs) -> DataFrame:
    rules = agents.Rules(
        browsers=[agents.Rule("Firefox/", "", "Fox"), agents.Rule("Safari/", r"Safari/([\d.]+)", "Webkit")],
        systems=[agents.Rule("Android", "", "Droid")], bot_words=["windows"])
    return parsing.read_hits(i.raw_log, rules=rules).where(F.col("error").isNull()).select(
        "event_timestamp", "browser_name", "browser_version", "browser_os_name", "request_is_bot")


def _first(rules, chosen) -> str:
    """A CASE over the rules in order."""
    cases = " ".join(f"WHEN contains(agent, '{r.token}') THEN {chosen(r)}" for r in rules)
    return f"CASE {cases} END"


def _found(r: agents.Rule) -> str:
    return f"nullif(regexp_extract(agent, '{r.pattern}', 1), '')" if r.pattern else "NULL"


_KERNELS = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in agents.WINDOWS_VERSIONS.items())
_KINDS = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in agents.DEVICE_TYPES.items())


@query("enrich_agent_dictionary", f"""
SELECT agent, browser_name, browser_version, browser_os_name,
  CASE WHEN browser_os_name = 'Windows' THEN CASE os_version {_KERNELS} ELSE os_version END ELSE os_version END AS browser_os_version,
  coalesce(CASE kind {_KINDS} END, 'Desktop') AS device_type, device_vendor, request_is_bot
FROM (SELECT agent, {_first(agents.BROWSERS, lambda r: f"'{r.name}'")} AS browser_name,
    {_first(agents.BROWSERS, _found)} AS browser_version,
    {_first(agents.SYSTEMS, lambda r: f"'{r.name}'")} AS browser_os_name,
    replace({_first(agents.SYSTEMS, _found)}, '_', '.') AS os_version,
    {_first(agents.DEVICE_KINDS, lambda r: f"'{r.name}'")} AS kind,
    {_first(agents.VENDORS, lambda r: f"'{r.name}'")} AS device_vendor,
    CAST(coalesce({" OR ".join(f"contains(lower(agent), '{w}')" for w in agents.BOT_WORDS)}, false) AS INT) AS request_is_bot
  FROM (SELECT url_decode(string_split(value, chr(9))[{parsing.FIELDS.index("user_agent") + 1}]) AS agent FROM raw_log))""")
def enrich_agent_dictionary(i: Inputs) -> DataFrame:
    lines = parsing.split_fields(i.raw_log).select(urls.percent_decode(F.col("user_agent")).alias("agent"))
    return dictionary.classify(lines, "agent", scratch(lines.sparkSession, "agents"))


@query("map_device_type", f"""
SELECT event_timestamp, CASE WHEN {_HUMAN} AND v % 4 >= 2 THEN 'Mobile' ELSE 'Desktop' END AS device_type
FROM hits""")
def map_device_type(i: Inputs) -> DataFrame:
    return _hits(i).select("event_timestamp", "device_type")


@query("flag_bots", """
SELECT event_timestamp, CAST(CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS INT) AS request_is_bot FROM hits""")
def flag_bots(i: Inputs) -> DataFrame:
    return _hits(i).select("event_timestamp", "request_is_bot")


@query("filter_client_rules", f"SELECT event_timestamp, domain_name, request_path FROM hits WHERE {_HUMAN}")
def filter_client_rules(i: Inputs) -> DataFrame:
    return parsing.drop_robots_and_local(_hits(i)).select("event_timestamp", "domain_name", "request_path")


@query("enrich_edge_location", """
SELECT event_timestamp, h.edge_id, city AS edge_city, state AS edge_state, country AS edge_country,
  country_code AS edge_country_code, latitude AS edge_latitude, longitude AS edge_longitude
FROM (SELECT *, CASE v % 3 WHEN 0 THEN 'HAM' WHEN 1 THEN 'SFO' ELSE 'ZZZ' END AS edge_id FROM hits) h
LEFT JOIN edges g ON g.edge_id = h.edge_id""")
def enrich_edge_location(i: Inputs) -> DataFrame:
    return dimensions.with_location(_hits(i), i.edges).select(
        "event_timestamp", "edge_id", "edge_city", "edge_state", "edge_country", "edge_country_code",
        "edge_latitude", "edge_longitude")


@query("classify_event_type", """
SELECT event_timestamp, CASE WHEN is_event THEN 'event' ELSE 'pageview' END AS event_type,
  CASE WHEN is_event THEN event_type END AS event_name, CASE WHEN is_event THEN props END AS event_data FROM hits""")
def classify_event_type(i: Inputs) -> DataFrame:
    return _hits(i).select("event_timestamp", "event_type", "event_name", "event_data")


_IDS = """
  sha256(concat(salt, ip, agent, event_date, domain_name)) AS daily_visitor_id,
  sha256(concat(salt, ip, agent, event_date, domain_name, request_path)) AS daily_page_view_id,
  sha256(concat(salt, ip, agent, event_date, domain_name, request_path,
    strftime(event_timestamp, '%a %b %d %Y %H:%M:%S'), ' GMT+0000 (Coordinated Universal Time)')) AS page_view_id"""


@query("pseudonymise_ids", f"SELECT event_timestamp, {_IDS} FROM hits WHERE salt IS NOT NULL")
def pseudonymise_ids(i: Inputs) -> DataFrame:
    salted = dimensions.with_salt(_hits(i), i.salts).where("salt is not null")
    return parsing.pseudonymise(salted).select(
        "event_timestamp", "daily_visitor_id", "daily_page_view_id", "page_view_id")


@query("lookup_salt", "SELECT event_timestamp, event_date, salt FROM hits")
def lookup_salt(i: Inputs) -> DataFrame:
    return dimensions.with_salt(_hits(i), i.salts).select("event_timestamp", "event_date", "salt")


@query("lookup_salt_conflict", """
SELECT event_timestamp, event_date, CASE WHEN event_date <> DATE '2024-01-10' THEN salt END AS salt FROM hits""")
def lookup_salt_conflict(i: Inputs) -> DataFrame:
    """A date with two salts has none."""
    other = i.salts.where("event_date = DATE '2024-01-10'").withColumn("salt", F.lit("another"))
    twice = i.salts.unionByName(i.salts.limit(3)).unionByName(other)
    return dimensions.with_salt(_hits(i), twice).select("event_timestamp", "event_date", "salt")


@query("verify_domains", """
SELECT event_timestamp, domain_name, concat('key', v % 3) AS domain_key FROM hits WHERE event_id % 17 <> 0""")
def verify_domains(i: Inputs) -> DataFrame:
    return dimensions.verified(_hits(i), i.domains).select("event_timestamp", "domain_name", "domain_key")


@query("reject_unverified", """
SELECT event_timestamp, domain_name, concat('Couldn''t verify ''', domain_name, ''' with domain key ''wrong''!') AS error
FROM hits WHERE event_id % 17 = 0""")
def reject_unverified(i: Inputs) -> DataFrame:
    return dimensions.unverified(_hits(i), i.domains).select("event_timestamp", "domain_name", "error")


@query("parse_outcomes", """
SELECT CASE WHEN coalesce(hit_error, later_error) IS NULL THEN 'Ok' ELSE 'Dropped' END AS result,
  coalesce(hit_error, later_error) AS error, count(*) AS n FROM log_truth GROUP BY 1, 2""")
def parse_outcomes(i: Inputs) -> DataFrame:
    outcomes = parsing.parse_outcomes(i.raw_log, i.domains, i.edges, i.salts)
    return outcomes.groupBy("result", "error").agg(F.count(F.lit(1)).alias("n"))


@query("parse_events", f"""
SELECT event_timestamp, arrival_timestamp, event_date, domain_name, request_path,
  concat('https://', domain_name, request_path) AS request_url, {_IDS}, city AS edge_city,
  CASE WHEN is_event THEN 'event' ELSE 'pageview' END AS event_type
FROM hits h LEFT JOIN edges g ON g.edge_id = CASE v % 3 WHEN 0 THEN 'HAM' WHEN 1 THEN 'SFO' END
WHERE later_error IS NULL""")
def parse_events(i: Inputs) -> DataFrame:
    events = parsing.parse_events(i.raw_log, i.domains, i.edges, i.salts)
    return events.select("event_timestamp", "arrival_timestamp", "event_date", "domain_name", "request_path",
                         "request_url", "daily_visitor_id", "daily_page_view_id", "page_view_id", "edge_city",
                         "event_type")


@query("parse_url_parts", """
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
  nullif(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '') AS path,
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def parse_url_parts(i: Inputs) -> DataFrame:
    url = F.col("url")
    query_text = urls.url_query(url)
    return i.table("pages").select(
        "page_id", urls.url_host(url).alias("host"), urls.url_path(url).alias("path"),
        urls.query_param(query_text, "utm_source").alias("utm_source"),
        urls.query_param(query_text, "page").alias("page"))


@query("event_data_fields", """
SELECT page_view_id, event_name, CAST(regexp_extract(event_data, '"k": ([0-9]+)', 1) AS INT) AS k
FROM pv WHERE event_type = 'event'""")
def event_data_fields(i: Inputs) -> DataFrame:
    return stats.curated_events(i.pv).select(
        "page_view_id", "event_name", F.get_json_object("event_data", "$.k").try_cast("int").alias("k"))


@query("country_codes", """
SELECT page_view_id, edge_country, country_code FROM pv LEFT JOIN countries c ON country = edge_country""")
def country_codes(i: Inputs) -> DataFrame:
    return dimensions.with_country_code(i.pv, i.countries).select("page_view_id", "edge_country", "country_code")



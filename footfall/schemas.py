"""Declared table layouts.

Every table is read with one of these DDL strings, so partition columns taken
from directory names always get the declared type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cleaned events: 48 data columns, then the 3 partition columns.
INCOMING = """
    event_year int, event_month int, event_day int,
    event_timestamp timestamp, arrival_timestamp timestamp, arrival_delay_ms bigint,
    edge_city string, edge_state string, edge_country string, edge_country_code string,
    edge_latitude float, edge_longitude float, edge_id string,
    referrer string, referrer_domain_name string,
    browser_name string, browser_version string, browser_os_name string, browser_os_version string,
    browser_timezone string, browser_language string,
    device_type string, device_vendor string, device_outer_resolution string,
    device_inner_resolution string, device_color_depth int, device_platform string,
    device_memory float, device_cores int,
    utm_source string, utm_campaign string, utm_medium string, utm_content string, utm_term string,
    request_url string, request_path string, request_query_string string, request_bytes bigint,
    request_status_code int, request_cache_status string, request_delivery_time_ms bigint,
    request_asn bigint, request_is_bot int, event_name string, event_data string,
    page_view_id string, daily_page_view_id string, daily_visitor_id string,
    domain_name string, event_type string, event_date date
"""

# The hourly statistics table: 18 dimensions and 4 measures.
STATS = """
    domain_name string, event_date date, event_hour int, edge_city string, edge_country string,
    edge_latitude float, edge_longitude float, referrer_domain_name string, browser_name string,
    browser_os_name string, device_type string, device_vendor string, utm_source string,
    utm_campaign string, utm_medium string, utm_content string, utm_term string,
    request_path string, page_views_cnt int, visitor_cnt int, bounce_cnt int,
    visit_duration_sec_avg int
"""

# Curated custom events.
EVENTS = """
    domain_name string, event_date date, event_timestamp timestamp, edge_city string,
    edge_country string, edge_latitude float, edge_longitude float, request_path string,
    page_view_id string, daily_visitor_id string, event_name string, event_data string
"""

SESSIONS = """
    domain_name string, event_date date, daily_visitor_id string, unique_daily_visitor_id string,
    first_page_view_id string, session_start_timestamp timestamp,
    session_end_timestamp timestamp, visit_duration_sec bigint, bounce_id string
"""

DOMAINS = "domain_name string, domain_key string, created_timestamp timestamp"
EDGES = ("edge_id string, city string, state string, country string, country_code string, "
         "latitude float, longitude float")
SALTS = "event_date date, salt string"
MANIFEST = ("file_type string, file_sub_type string, file_name string, file_domain_name string, "
            "file_event_date date, file_created_timestamp timestamp, file_size bigint, "
            "s3_bucket string, s3_key string")


def names(ddl: str) -> list[str]:
    """Column names of a DDL string."""
    return [part.split()[0] for part in ddl.split(",")]


MEASURES = ["page_views_cnt", "visitor_cnt", "bounce_cnt", "visit_duration_sec_avg"]
DIMS = [c for c in names(STATS) if c not in MEASURES]
# Dimensions that are stored columns of a page view; the hour is derived.
STORED_DIMS = [c for c in DIMS if c != "event_hour"]


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A typed table without rows."""
    return spark.createDataFrame([], ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select and cast a DataFrame to a declared layout, by column name."""
    typed = (part.strip().rsplit(" ", 1) for part in ddl.split(","))
    return df.select(*(F.col(name.strip()).cast(kind).alias(name.strip()) for name, kind in typed))

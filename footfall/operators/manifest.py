"""The list of stored files, folded from object notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions.urls import blank_to_null, percent_decode
from footfall.operators.parsing import computed_once

# First folder of a key -> file type.
FILE_TYPES = {"incoming": "cleaned", "aggregated": "curated"}


def _pair(key: Column, name: str) -> Column:
    """Value of a ``name=value`` folder anywhere in the key."""
    return blank_to_null(F.regexp_extract(key, f"(?:^|/){name}=([^/]*)/", 1))


def parse_keys(objects: DataFrame, key: str = "s3_key") -> DataFrame:
    """Add what an object key tells, read by folder name rather than by position.

    ``file_type`` is NULL for keys outside the two known areas.
    """
    decoded = percent_decode(percent_decode(F.col(key)))
    df = objects.withColumn(key, F.coalesce(decoded, F.col(key)))
    text = F.col(key)
    parts = F.split(text, "/")
    area = F.get(parts, F.lit(0))
    kinds = F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair))
    return df.withColumns({
        "file_type": kinds[area],
        "file_sub_type": F.when(area == "incoming", _pair(text, "event_type"))
                          .when(area == "aggregated", F.get(parts, F.lit(1))),
        "file_domain_name": _pair(text, "domain_name"),
        "file_event_date": _pair(text, "event_date").try_cast("date"),
        "file_event_hour": _pair(text, "event_hour").try_cast("int"),
        "file_event_name": _pair(text, "event_name"),
        "file_name": F.element_at(parts, -1),
    })


def newest_notifications(events: DataFrame) -> DataFrame:
    """(s3_bucket, s3_key, last): what the newest notification of each object says, removed objects included.

    Expects ``event_name, event_time, s3_bucket, s3_key, file_size``, with an optional
    ``sequencer`` for notifications of one instant. The newest notification is an
    aggregate, so an object with very many of them is combined before the shuffle, the order of
    arrival does not matter and repeated notifications change nothing. On a stream it is the state.
    """
    action = F.substring_index("event_name", ":", 1)
    order = F.col("sequencer") if "sequencer" in events.columns else F.lit(None).cast("string")
    decoded = F.coalesce(percent_decode(percent_decode(F.col("s3_key"))), F.col("s3_key"))
    area = F.substring_index("s3_key", "/", 1)
    known = computed_once(events.withColumn("s3_key", decoded), "s3_key").where(
        action.isin("ObjectCreated", "ObjectRemoved") & area.isin(*FILE_TYPES))
    return known.groupBy("s3_bucket", "s3_key").agg(F.max(F.struct(
        F.col("event_time"), order.alias("sequencer"), (action == "ObjectCreated").alias("exists"),
        "file_size")).alias("last"))


def existing(newest: DataFrame) -> DataFrame:
    """The files whose newest notification says that they exist."""
    alive = newest.where(F.col("last.exists")).select(
        "s3_bucket", "s3_key", F.col("last.event_time").alias("file_created_timestamp"),
        F.col("last.file_size").alias("file_size"))
    return parse_keys(alive).select(*schemas.names(schemas.MANIFEST), "file_event_hour", "file_event_name")


def current_files(events: DataFrame) -> DataFrame:
    """Files that exist after all notifications: the newest one per object decides."""
    return existing(newest_notifications(events))


def list_files(manifest: DataFrame, day, prefix: str) -> DataFrame:
    """Files of one date below a key prefix."""
    return manifest.where((F.col("file_event_date") == F.lit(day).cast("date"))
                          & F.col("s3_key").startswith(prefix))


def touched_days(manifest: DataFrame, since) -> DataFrame:
    """Dates of the cleaned events' files that were created at or after a moment, as ``event_date``."""
    return manifest.where((F.col("file_type") == "cleaned") & (F.col("file_created_timestamp") >= F.lit(since).cast("timestamp"))) \
        .select(F.col("file_event_date").alias("event_date")).distinct()


def today_prefix(day) -> str:
    return f"aggregated/daily-stats/event_date={day}"


def files_today(manifest: DataFrame, day) -> DataFrame:
    """Number of today's statistics files, and when the newest one was made."""
    return list_files(manifest, day, today_prefix(day)).agg(
        F.count("s3_key").alias("file_count"), F.max("file_created_timestamp").alias("newest_file"))


def today_changed(manifest: DataFrame, day, last_count: int | None, last_newest=None) -> bool:
    """Whether today's statistics have to be read again: files came, went or, given their time, were replaced."""
    now = files_today(manifest, day).first()
    return now["file_count"] != last_count or (last_newest is not None and now["newest_file"] != last_newest)

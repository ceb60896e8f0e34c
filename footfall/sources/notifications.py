"""Object notifications: a JSON envelope around a JSON message around records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENVELOPE = "Records array<struct<Sns: struct<Message: string>>>"
MESSAGE = ("Records array<struct<eventName: string, eventTime: string, s3: struct<"
           "bucket: struct<name: string>, object: struct<key: string, size: bigint, sequencer: string>>>>")


def read_notifications(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per object event; all records of an envelope count, broken JSON gives none.

    The outer generators keep Catalyst from deriving filters that would parse the JSON
    again; rows without a record are dropped at the end.
    """
    envelopes = df.select(F.explode_outer(F.from_json(F.col(value), ENVELOPE)["Records"]).alias("envelope"))
    messages = envelopes.select(F.from_json(F.col("envelope.Sns.Message"), MESSAGE)["Records"].alias("records"))
    rows = messages.select(F.inline_outer("records")).where(F.col("eventName").isNotNull())
    return rows.select(
        F.col("eventName").alias("event_name"),
        F.col("eventTime").try_cast("timestamp").alias("event_time"),
        F.col("s3.bucket.name").alias("s3_bucket"),
        F.col("s3.object.key").alias("s3_key"),
        F.col("s3.object.size").alias("file_size"),
        F.col("s3.object.sequencer").alias("sequencer"))

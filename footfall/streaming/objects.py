"""The list of stored files, kept up to date by a stream of object notifications.

The state holds the newest notification of each object, the removed ones too: only so can an older one that arrives late be told from a
newer one. Each batch writes the objects whose state it touched; the list is the last written row of each. ``live.merge_batches`` with
the keys of an object keeps the folders few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from footfall.operators import manifest
from footfall.sources.notifications import read_notifications
from footfall.streaming import live

OBJECT = ["s3_bucket", "s3_key"]


def follow(notifications: DataFrame, path: str, checkpoint: str, every: str | None = "1 minute") -> StreamingQuery:
    """Fold a stream of notification messages; ``every=None`` takes what is there and stops."""
    return live.keep_newest(manifest.newest_notifications(read_notifications(notifications)), path, checkpoint, every)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files that exist by what the stream has written so far."""
    return manifest.existing(live.newest(live.written(spark, path), OBJECT))


def merge(spark: SparkSession, path: str, before: int, keep: int = 1) -> None:
    live.merge_batches(spark, path, OBJECT, before, keep)

"""Continuous ingest: lines in, cleaned events, raw backup and rejects out."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall import schemas
from footfall.operators import dimensions, parsing, stats
from footfall.sinks import commits, raw
from footfall.sinks import tables as out
from footfall.sources import tables as src

EVERY = "15 minutes"
# Shuffled lines that one task parses. Lines shrink to about a sixth in a shuffle, their cached columns hardly do.
PARSED_AT_ONCE = "8m"
DEALT = "1000"  # parts that lines are dealt to before adaptive execution joins them up to that size
_SEEN = "_seen"  # time of a line's batch


class Dimensions(NamedTuple):
    domains: DataFrame
    edges: DataFrame
    salts: DataFrame


class Targets(NamedTuple):
    """Folders of the three outputs below one root."""

    root: str

    @property
    def incoming(self) -> str:
        return f"{self.root}/incoming"

    @property
    def backup(self) -> str:
        return f"{self.root}/raw"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"


@contextmanager
def _set(spark: SparkSession, **adaptive: str) -> Iterator[None]:
    """Settings of adaptive execution that hold for a block; ``__`` stands for a dot."""
    keys = {f"spark.sql.adaptive.{k.replace('__', '.')}": v for k, v in adaptive.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def batch_writer(load: Callable[[], Dimensions], targets: Targets, **options):
    """The function applied to every micro-batch.

    ``load`` is called once per batch, so changes of the registry take effect with the
    next one. Every output of a batch is a folder of its own that is replaced as a whole: a
    batch repeated after a failure leaves neither duplicates nor, when the registry has
    changed meanwhile, rows of its first run. ``compact`` merges the folders of old batches.

    Lines are dealt out by size before they are parsed and cached, since a few files may give many lines; parsing and backup read
    the same shuffle. ``store`` and ``once``, the time within which a line counts once, are those of ``first_deliveries``.
    """
    once = options.pop("once", None)
    store = options.pop("store", None)

    def write(lines: DataFrame, batch: int) -> None:
        # A stream may plan without adaptive execution; what its batch has become by now may be split by size again.
        with _set(lines.sparkSession, enabled="true"):
            write_all(lines, batch)

    def write_all(lines: DataFrame, batch: int) -> None:
        dims = load()
        value = options.get("value", "value")
        # What is dealt out, and the cached plan, keep these settings.
        with _set(lines.sparkSession, advisoryPartitionSizeInBytes=PARSED_AT_ONCE, coalescePartitions__initialPartitionNum=DEALT):
            dealt = _shuffled(lines.hint("rebalance") if once is None else first_deliveries(lines, store, batch, once, value))
            outcomes = parsing.parse_outcomes(dealt, *dims, **{k: v for k, v in options.items() if k != "distinct"}).persist()
        try:
            events = parsing.accepted(outcomes)
            if options.get("distinct"):
                events = stats.without_repeats(events)
            out.write_partitions(events, f"{targets.incoming}/batch_id={batch}", out.INCOMING_PARTITIONS,
                                 ["daily_visitor_id", "event_timestamp"], whole=True)
            raw.write_rejects(outcomes, targets.rejects, batch=batch)
        finally:
            outcomes.unpersist()
        raw.write_backup(dealt, targets.backup, value, batch=batch)
        if once is not None:
            at = lines.select(F.unix_micros(_SEEN)).first()
            if at is not None:
                remember(dealt, store, batch, at[0], once)

    return write


def _shuffled(df: DataFrame) -> DataFrame:
    """The same rows, for several actions: the shuffle runs here, once, and each action begins with what it wrote."""
    spark, made = df.sparkSession, df._jdf
    rows = made.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, made.schema(), False), spark)


def _micros(spark: SparkSession, within: str) -> int:
    """A length of time such as ``1 day`` in microseconds; a month has 31 days."""
    found = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.lit(within).cast("interval"))).first()[0]
    if found is None or found < 0:
        raise ValueError(f"no length of time: {within}")
    return found


def _batches(spark: SparkSession, store: str) -> list[tuple[int, int, str]]:
    """Number, time in microseconds and folder of the batches whose digests are kept."""
    found = (re.fullmatch(r"batch=(\d+)-at=(\d+)", name) for name in src.folders(spark, store))
    return sorted((int(m[1]), int(m[2]), f"{store}/{m[0]}") for m in found if m)


def _kept(batches: list[tuple[int, int, str]], batch: int, within: int) -> list[str]:
    """Folders that a batch looks at: of the batches before it, but for those that another of them came after by twice that time."""
    before = [b for b in batches if b[0] < batch]
    last = max((at for _, at, _ in before), default=0)
    return [path for _, at, path in before if at + 2 * within > last]


def first_deliveries(lines: DataFrame, store: str, batch: int, within: str, value: str = "value") -> DataFrame:
    """Lines of a batch that no batch before it has taken, within a time of at most that long ago at least; each once, with its digest.

    ``store`` has a folder of digests for each batch, by the time of the batch and not by that of its lines: so a line that arrives late
    is never dropped, and a batch repeated after a failure, which looks at the batches before it only, finds what it found before.
    Lines and digests meet in one shuffle, which deals the lines out by size as well; no task holds digests from batch to batch.
    """
    spark = lines.sparkSession
    # No digest is empty, so that stands for missing lines, which count as one.
    digest = F.coalesce(F.unhex(F.md5(F.col(value))), F.lit(b""))
    keyed = lines.select(value, digest.alias("_digest"))
    paths = _kept(_batches(spark, store), batch, _micros(spark, within))
    if paths:
        known = spark.read.schema("_digest binary").parquet(*paths)
        keyed = keyed.join(known.hint("shuffle_hash"), "_digest", "left_anti")
    return keyed.distinct()


def remember(fresh: DataFrame, store: str, batch: int, at: int, within: str) -> None:
    """Keep the digests of a batch of a time; written again, they replace those of its first run. What is too old goes."""
    spark = fresh.sparkSession
    batches, path = _batches(spark, store), f"{store}/batch={batch}-at={at}"
    fresh.select("_digest").write.mode("overwrite").parquet(path)
    kept = _kept(batches, batch, _micros(spark, within))
    for number, _, old in batches:
        if (number < batch and old not in kept) or (number == batch and old != path):
            src.remove(spark, old)


def patient(write: Callable[[DataFrame, int], None], attempts: int, wait: float) -> Callable[[DataFrame, int], None]:
    """Try a batch again after a failure, waiting twice as long each time; the last failure ends the stream."""

    def write_again(df: DataFrame, batch: int) -> None:
        for k in range(attempts):
            try:
                return write(df, batch)
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(wait * 2**k)

    return write_again


def start_ingest(lines: DataFrame, load: Callable[[], Dimensions], targets: Targets, checkpoint: str,
                 every: str | None = EVERY, once: str | None = None, attempts: int = 1, wait: float = 1.0, **options) -> StreamingQuery:
    """Run the ingest; ``every=None`` takes what is there and stops.

    ``once``, such as ``1 day``, takes a line that is delivered again within that time only once, in whichever batch it comes.
    ``attempts`` is how often a batch is tried before the stream fails.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    if once is not None:
        _micros(lines.sparkSession, once)  # a text that is no time fails here
        lines = lines.withColumn(_SEEN, F.current_timestamp())
        options |= {"once": once, "store": f"{checkpoint}/digests"}
    return (lines.writeStream.foreachBatch(patient(batch_writer(load, targets, **options), attempts, wait))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def verified_stream(hits: DataFrame, load: Callable[[], DataFrame], write: Callable[[DataFrame, int], None],
                    checkpoint: str, every: str | None = EVERY) -> StreamingQuery:
    """Pass on the events of registered domains, reading the registry anew per batch."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (hits.writeStream
            .foreachBatch(lambda df, batch: write(dimensions.verified(df, load()), batch))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def compact(spark, targets: Targets, before: int, keep: int = 1) -> None:
    """Merge the cleaned events of the batches before a number into one folder, under a commit record (see ``commits``).

    Only batches that can no longer be repeated may be given.
    """

    def write(rows: DataFrame, path: str) -> None:
        out.write_partitions(schemas.conform(rows, schemas.INCOMING), path, out.INCOMING_PARTITIONS,
                             ["daily_visitor_id", "event_timestamp"], whole=True)

    commits.merge(spark, targets.incoming, before, write, schemas.INCOMING, keep)


def stored(spark, targets: Targets) -> DataFrame:
    """Cleaned events written by the ingest."""
    return commits.read(spark, targets.incoming, schemas.INCOMING)

"""Today's statistics kept by two streams, without counting a day again.

Page views need no state: each batch adds its sums to a ledger. Visits do: the state of a visitor and day are the time slots with page views,
at most 48, each with its landing row and its last time. Slots that come, grow or join two visits change the visits; the visits that no
longer count are taken away and the new ones added, so the ledger equals a batch count of all rows so far after every batch, also while
visits are open and when rows come out of order. A timer drops a visitor's state once the watermark has passed the day's end.

Before the shuffle the rows of a visitor's slot are combined in each task, so a visitor with very many rows arrives as a few.

Rows later than ``lateness`` are not seen by the visits' stream (their page views count); count the day anew for them, or correct it
with ``ledger.add_late`` where neither stream has read them. Rows without a time make no visit. The state is kept in RocksDB.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from footfall import schemas
from footfall.operators import partials
from footfall.operators.sessions import GAP_SECONDS, VISITOR
from footfall.plans import ledger

LATENESS = "1 day"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = 200_000  # rows that a task combines at once
CARRY = [c for c in schemas.STORED_DIMS if c not in ("domain_name", "event_date")]
_KINDS = {p.split()[0]: p.split()[1] for p in schemas.STATS.split(",")}
_SLOTS = ", ".join([*[f"{c} {'date' if c == 'event_date' else 'string'}" for c in VISITOR], "slot bigint", "first_us bigint", "last_us bigint",
                    "page_view_id string", "landing string", "ends_ms bigint"])
_CHANGES = "domain_name string, event_date date, landing string, first_us bigint, single boolean, visit_duration_sec bigint, times int"
_CHANGE_COLUMNS = ["domain_name", "event_date", "landing", "first_us", "single", "visit_duration_sec", "times"]


class Today(NamedTuple):
    """Folders of the two ledgers below one root."""

    root: str

    @property
    def views(self) -> str:
        return f"{self.root}/views"

    @property
    def visits(self) -> str:
        return f"{self.root}/visits"


def folded(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per visitor and slot: the landing row, and the last time."""
    by = [*VISITOR, "slot"]
    last = rows.groupby(by, dropna=False, sort=False)["last_us"].transform("max")
    ordered = rows.assign(last_us=last).sort_values(["first_us", "page_view_id"], na_position="first", kind="stable")
    return ordered.drop_duplicates(by, keep="first")


def combined(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task, folded as they come, with a bounded number waiting."""
    waiting: list[pd.DataFrame] = []
    for part in parts:
        waiting.append(part)
        if sum(map(len, waiting)) > WAITING:
            waiting = [folded(pd.concat(waiting))]
            if len(waiting[0]) > WAITING // 2:
                yield waiting.pop()
    if waiting:
        yield folded(pd.concat(waiting))


def slots(views: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Page views with their slot, folded in each task."""
    at = F.unix_micros("event_timestamp")
    ends = F.unix_millis(F.coalesce(F.col("event_date").cast("timestamp"), F.date_trunc("day", "event_timestamp")) + F.expr("interval 1 day"))
    rows = views.where(F.col("event_timestamp").isNotNull()).select(
        *VISITOR, F.floor(F.unix_timestamp("event_timestamp") / max(gap, 1)).cast("bigint").alias("slot"), at.alias("first_us"),
        at.alias("last_us"), "page_view_id", F.to_json(F.struct(*CARRY), {"ignoreNullFields": "false"}).alias("landing"), ends.alias("ends_ms"))
    return rows.mapInPandas(combined, _SLOTS)


def visits_of(known: list[list], gap: int) -> Counter:
    """(landing, first time, single, seconds) of the visits that slots make; slots are in order."""
    out: Counter = Counter()
    first = last = None
    for slot in known:
        if first is not None and slot[1] // 1_000_000 - last // 1_000_000 <= gap:
            last = slot[4]
            continue
        if first is not None:
            out[first[3], first[1], first[1] == last, last // 1_000_000 - first[1] // 1_000_000] += 1
        first, last = slot, slot[4]
    if first is not None:
        out[first[3], first[1], first[1] == last, last // 1_000_000 - first[1] // 1_000_000] += 1
    return out


def joined(known: list[list], rows: Iterable[list]) -> list[list]:
    """Slots with further rows: [slot, first time, page view, landing, last time] each."""
    by_slot = {slot[0]: slot for slot in known}
    for row in rows:
        old = by_slot.get(row[0])
        if old is None:
            by_slot[row[0]] = row
            continue
        landing = min(old, row, key=lambda s: (s[1], s[2] is not None, s[2] or ""))
        by_slot[row[0]] = [*landing[:4], max(old[4], row[4])]
    return [by_slot[k] for k in sorted(by_slot)]


class Visits(StatefulProcessor):
    """Holds the slots of one visitor and day; emits the visits that come and go."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", "slots string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = json.loads(self.slots.get()[0]) if self.slots.exists() else []
        now, ends = known, None
        for part in rows:
            ids = [None if pd.isna(x) else x for x in part["page_view_id"]]
            columns = [part[c].tolist() for c in ("slot", "first_us", "landing", "last_us")]
            now = joined(now, [[s, f, i, landing, last] for s, f, landing, last, i in zip(*columns, ids)])
            ends = int(part["ends_ms"].max())
        if not known and ends is not None:
            self.handle.registerTimer(ends)
        if now != known:
            self.slots.update((json.dumps(now),))
        before, after = visits_of(known, self.gap), visits_of(now, self.gap)
        changes = [(*key[:2], *v, -n) for v, n in (before - after).items()] + [(*key[:2], *v, n) for v, n in (after - before).items()]
        yield pd.DataFrame(changes, columns=_CHANGE_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.slots.clear()
        yield pd.DataFrame([], columns=_CHANGE_COLUMNS)

    def close(self) -> None:
        pass


def visit_changes(views: DataFrame, gap: int = GAP_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """A stream of visits that come (``times`` 1) and go (-1), with the dimensions of their landing rows."""
    timed = slots(views, gap).withColumn("seen", F.timestamp_micros("last_us")).withWatermark("seen", lateness)
    changes = timed.groupBy(*VISITOR).transformWithStateInPandas(Visits(gap), _CHANGES, "append", "EventTime")
    landing = F.from_json("landing", ", ".join(f"{c} {_KINDS[c]}" for c in CARRY)).alias("landing")
    return changes.select("domain_name", "event_date", F.hour(F.timestamp_micros("first_us")).alias("event_hour"), landing, "single",
                          "visit_duration_sec", "times").select("*", "landing.*").drop("landing")


@contextmanager
def _state_in_rocks(spark: SparkSession):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def start(views: DataFrame, today: Today, checkpoint: str, every: str | None = "1 minute", gap: int = GAP_SECONDS,
          lateness: str = LATENESS) -> list[StreamingQuery]:
    """Keep the ledgers up to date with a stream of page views; ``every=None`` takes what is there and stops."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def add_views(batch: DataFrame, number: int) -> None:
        ledger.add(partials.of_views(batch), today.views, number)

    def add_visits(batch: DataFrame, number: int) -> None:
        ledger.add(partials.of_visits(batch, schemas.DIMS, F.col("times")), today.visits, number)

    with _state_in_rocks(views.sparkSession):
        return [df.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**trigger).start()
                for name, df, write in (("views", views, add_views), ("visits", visit_changes(views, gap, lateness), add_visits))]


def table(spark: SparkSession, today: Today) -> DataFrame:
    """The statistics of all rows that the streams have taken in."""
    return ledger.table(spark, today.views, today.visits)

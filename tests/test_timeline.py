"""The registry in time against a plain walk through the changes, and visitors from sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from footfall.operators import distincts, timeline

START = dt.datetime(2024, 1, 1)
CHANGES = "domain_name string, domain_key string, changed_at timestamp, deleted boolean, __steps int"
EVENTS = "domain_name string, domain_key string, event_timestamp timestamp, slice string, steps int"


def minute(n):
    return None if n is None else START + dt.timedelta(minutes=n)


def key_at(changes, domain, at):
    """The key after all changes up to the moment."""
    past = [c for c in changes if c[0] == domain and c[0] is not None and c[2] is not None and at is not None and c[2] <= at]
    if not past:
        return None
    newest = max(c[2] for c in past)
    return max((c[1] for c in past if c[2] == newest and not c[3] and c[1] is not None), default=None)


@pytest.mark.parametrize("seconds", [60, 3600, 86400 * 400])
def test_key_at_every_moment(spark, seconds):
    rnd = random.Random(4)
    changes = [(rnd.choice("abc"), rnd.choice("klm"), minute(rnd.randrange(600)), rnd.choice([True, False, None]), 1) for _ in range(150)]
    changes += [("hot", rnd.choice("klm"), minute(rnd.randrange(90)), rnd.random() < 0.3, 1) for _ in range(300)]
    changes += [(None, "k", minute(3), False, 1), ("a", "k", None, False, 1), ("b", None, minute(70), False, 1)]
    changes += [("old", "k", minute(-60 * 24 * 40), False, 1), changes[0], changes[0]]
    events = [(rnd.choice(["a", "b", "c", "hot", "old", "none", None]), rnd.choice("klm"), minute(rnd.randrange(-5, 700)), "s", n)
              for n in range(400)]
    events += [("a", None, minute(650), "s", 400), ("a", "k", None, "s", 401), events[0], events[0]]
    got = timeline.with_key_then(spark.createDataFrame(events, EVENTS), spark.createDataFrame(changes, CHANGES), seconds=seconds)
    assert got.columns == ["domain_name", "domain_key", "event_timestamp", "slice", "steps", "key_then"]
    want = sorted(map(str, [(*e, key_at(changes, e[0], e[2])) for e in events]))
    assert sorted(map(str, map(tuple, got.collect()))) == want


def test_lines_of_a_removed_domain_count_up_to_its_removal(spark):
    changes = spark.createDataFrame([("a", "k", minute(10), False, 0), ("a", "k", minute(50), True, 0), ("a", "l", minute(90), False, 0)], CHANGES)
    events = spark.createDataFrame([("a", "k", minute(n), "", n) for n in range(0, 120, 10)], EVENTS)
    assert sorted(r.steps for r in timeline.verified_then(events, changes).collect()) == [10, 20, 30, 40]
    left = {r.steps: r.key_then for r in timeline.unverified_then(events, changes).collect()}
    assert left == {0: None, 50: None, 60: None, 70: None, 80: None, 90: "l", 100: "l", 110: "l"}
    assert sorted(map(tuple, timeline.intervals(changes, 1800).collect())) == [
        ("a", "k", minute(10), minute(50)), ("a", "l", minute(90), None)]
    assert timeline.verified_then(events, changes.limit(0)).count() == 0 == timeline.intervals(changes.limit(0)).count()
    assert timeline.with_key_then(events.limit(0), changes).count() == 0


def test_visitors_of_thirty_days_within_the_stated_error(spark):
    rows = spark.range(400_000).select("id",
        F.concat(F.lit("v"), (F.xxhash64("id") % 90_000).cast("string")).alias("daily_visitor_id"), F.lit("a.example").alias("domain_name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("event_date"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("b"), (F.col("id") % 3).cast("string"))).alias("browser_name"))
    dims = ["domain_name", "event_date", "browser_name"]
    stored = distincts.sketches(rows.where("id % 5 > 0"), dims)
    stored = distincts.added(stored, rows.where("id % 5 < 2"), dims)  # late ones, and some again
    for by in ([], ["domain_name"], ["browser_name"]):
        exact = {tuple(r[:-1]): r[-1] for r in rows.where("event_date between '2024-01-03' and '2024-02-01'").groupBy(*by).agg(
            F.count_distinct("daily_visitor_id")).collect()}
        got = {tuple(r[c] for c in by): r for r in distincts.between(stored, "2024-01-03", "2024-02-01", by).collect()}
        assert got.keys() == exact.keys() and min(exact.values()) > 50_000
        assert all(r.visitors_low <= exact[k] <= r.visitors_high for k, r in got.items())
        assert all(abs(r.visitors - exact[k]) <= 3 * distincts.error() * exact[k] for k, r in got.items())


def test_visitors_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", None, "x", 1), ("a", "", "x", 1), ("a", "v", "x", 2), ("a", "v", "x", 2), (None, "v", "x", 1), ("b", None, "x", 1)],
                                 "domain_name string, daily_visitor_id string, visitor_sketch string, n int")
    rows = rows.withColumn("event_date", F.lit("2024-01-01").cast("date"))
    stored = distincts.sketches(rows, ["domain_name", "event_date"])
    got = {r.domain_name: r.visitors for r in distincts.between(stored, "2024-01-01", "2024-01-01").collect()}
    assert got == {"a": 2, None: 1, "b": 0}
    assert distincts.between(stored.limit(0), "2024-01-01", "2024-01-02").count() == 0

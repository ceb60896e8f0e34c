"""Visits: gap rules, ties, hot visitors, and both modes against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from footfall.operators import sessions, stats
from footfall.operators.neighbours import with_neighbours

DAY = dt.datetime(2024, 1, 5)


def at(seconds: float) -> str:
    return str(DAY + dt.timedelta(seconds=seconds))


def found(df):
    return sorted((r.daily_visitor_id, r.first_page_view_id, r.visit_duration_sec, r.bounce_id is not None)
                  for r in df.collect())


def test_gap_of_exactly_the_limit_stays(views):
    v = views([("u", at(0), "a"), ("u", at(1800), "b"), ("u", at(3601), "c")])
    assert found(sessions.sessionize_gap(v)) == [("u", "a", 1800, False), ("u", "c", 0, True)]


def test_gap_counts_whole_seconds(views):
    # 1800.2 s apart, but only 1800 second boundaries are crossed.
    v = views([("u", at(0.1), "a"), ("u", at(1800.3), "b")])
    assert found(sessions.sessionize_gap(v)) == [("u", "a", 1800, False)]
    # 1800.9 s apart, with 1801 boundaries.
    v = views([("u", at(0.95), "a"), ("u", at(1801.05), "b")])
    assert len(found(sessions.sessionize_gap(v))) == 2


def test_visits_end_at_midnight(views):
    v = views([("u", at(86390), "a"), ("u", at(86410), "b")])
    assert len(found(sessions.sessionize_gap(v))) == 2


def test_ties_take_the_smaller_page_view_id(views):
    v = views([("u", at(5), "b"), ("u", at(5), "a")])
    assert found(sessions.sessionize_gap(v)) == [("u", "a", 0, True)]


def test_first_two_single_visits_merge_only_in_boundary_mode(views):
    v = views([("u", at(0), "a"), ("u", at(10000), "b")])
    assert len(found(sessions.sessionize(v))) == 2
    assert found(sessions.sessionize(v, mode="boundary")) == [("u", "a", 10000, False)]


def test_equal_times_split_in_boundary_mode(views):
    v = views([("u", at(0), "a"), ("u", at(60), "b"), ("u", at(60), "c"), ("u", at(90), "d")])
    rows = {r.page_view_id: (r.is_session_start, r.is_session_end) for r in sessions.boundary_rows(v).collect()}
    assert rows == {"a": (True, False), "b": (False, True), "c": (True, False), "d": (False, True)}
    assert found(sessions.sessionize(v, mode="boundary")) == [("u", "a", 60, False), ("u", "c", 30, False)]


def test_unknown_mode_is_refused(views):
    with pytest.raises(ValueError):
        sessions.sessionize(views([("u", at(0), "a")]), mode="other")


def by_hand(rows, gap=1800):
    """Gap visits of (visitor, second, id) rows: first id, duration, page views."""
    out, current = [], None
    for visitor, second, name in sorted(rows):
        if current and current[0] == visitor and second - current[2] <= gap:
            current[2], current[4] = second, current[4] + 1
        else:
            current = [visitor, second, second, name, 1]
            out.append(current)
    return sorted((v, name, last - first, n) for v, first, last, name, n in out)


@pytest.mark.parametrize("gap", [1, 1800])
def test_random_visits_equal_a_plain_loop(spark, views, gap):
    rng = random.Random(gap)
    seconds = rng.sample(range(80000), 700)
    rows = [(rng.choice("uvw"), s, f"p{i:04d}") for i, s in enumerate(seconds)]
    v = views([(u, at(s), p) for u, s, p in rows])
    attached = sessions.attach_sessions(v, gap).groupBy("daily_visitor_id", "first_page_view_id").agg(
        F.max("event_timestamp").alias("last"), F.min("event_timestamp").alias("first"),
        F.count("page_view_id").alias("n"))
    mine = sorted((r.daily_visitor_id, r.first_page_view_id, int((r.last - r.first).total_seconds()), r.n)
                  for r in attached.collect())
    assert mine == by_hand(rows, gap)
    shuffled = v.repartition(13, "page_view_id")
    assert found(sessions.sessionize_gap(shuffled, gap)) == sorted(
        (u, p, d, d == 0) for u, p, d, _ in by_hand(rows, gap))


def test_hot_visitor_arrives_as_few_rows(spark, views):
    """A visitor with a third of all rows is reduced to at most one row per half hour."""
    v = views([("hot", at(i * 4.3), f"h{i:05d}") for i in range(20000)]
              + [(f"u{i % 5000}", at(i * 2.1), f"p{i:05d}") for i in range(40000)])
    slots = sessions._slots(v, 1800, ())
    assert slots.where("daily_visitor_id = 'hot'").count() <= 48
    hot = [r for r in sessions.sessionize_gap(v).where("daily_visitor_id = 'hot'").collect()]
    assert len(hot) == 1 and hot[0].visit_duration_sec == int(19999 * 4.3)
    assert sessions.sessionize_gap(v).agg(F.countDistinct("unique_daily_visitor_id")).first()[0] \
        == sessions.sessionize_gap(v).count()


@pytest.mark.parametrize("slice_seconds", [0.5, 60])
def test_neighbours_equal_a_plain_window(spark, views, slice_seconds):
    rng = random.Random(7)
    v = views([(rng.choice("uv"), at(rng.choice([rng.random() * 500, 40, rng.random() * 80000])), f"p{i}")
               for i in range(400)])
    key = sessions.VISITOR
    order = Window.partitionBy(*key).orderBy("event_timestamp", "page_view_id")
    plain = v.select("page_view_id", F.lag("page_view_id").over(order).alias("b"),
                     F.lead("page_view_id").over(order).alias("a"))
    mine = with_neighbours(v, key, slice_seconds=slice_seconds).select(
        "page_view_id", F.col("prev.page_view_id").alias("b"), F.col("next.page_view_id").alias("a"))
    assert sorted(mine.collect(), key=str) == sorted(plain.collect(), key=str)


def test_stats_forms_agree_and_add_up(spark, views):
    rng = random.Random(3)
    v = views([(rng.choice("uvwxyz"), at(rng.random() * 86000), f"p{i}") for i in range(900)])
    v = v.withColumn("request_path", F.concat(F.lit("/"), F.expr("cast(crc32(page_view_id) % 7 as string)")))
    free, joined = stats.hourly_stats(v), stats.joined_stats(v, sessions.sessionize(v))
    assert sorted(free.collect(), key=str) == sorted(joined.select(free.columns).collect(), key=str)
    total = free.agg(F.sum("page_views_cnt"), F.sum("visitor_cnt"), F.sum("bounce_cnt")).first()
    visits = sessions.sessionize_gap(v)
    assert tuple(total) == (900, visits.count(), visits.where("bounce_id is not null").count())


def test_copies_count_as_page_views_but_not_as_visits(views):
    v = views([("u", at(0), "a"), ("u", at(0), "a"), ("u", at(5), "b")])
    row = stats.hourly_stats(v).first()
    assert (row.page_views_cnt, row.visitor_cnt, row.bounce_cnt, row.visit_duration_sec_avg) == (3, 1, 0, 5)
    assert stats.hourly_stats(stats.without_repeats(v)).first().page_views_cnt == 2
    assert found(sessions.sessionize(v, mode="boundary")) == [("u", "a", 5, False)]


def test_empty_day(views):
    v = views([("u", at(0), "a")])
    assert stats.daily_stats(v, "2024-02-01").count() == 0


def test_missing_visitors_keep_their_rows(spark, views):
    rows = [(None, "2024-01-05 10:00:00", "p1"), (None, "2024-01-05 10:00:15", "p2"), ("u", "2024-01-05 11:00:00", "p3"),
            (None, "2024-01-05 12:00:00", "p4")]
    some = views(rows)
    attached = sessions.attach_sessions(some)
    assert sorted((r.page_view_id, r.session_no, r.first_page_view_id) for r in attached.collect()) == [
        ("p1", 1, "p1"), ("p2", 1, "p1"), ("p3", 1, "p3"), ("p4", 2, "p4")]
    assert len(attached.columns) == len(set(attached.columns))
    whole, joined = stats.hourly_stats(some), stats.joined_stats(some, sessions.sessionize(some))
    assert sorted(map(str, whole.collect())) == sorted(map(str, joined.select(whole.columns).collect()))
    assert whole.agg({"visitor_cnt": "sum"}).first()[0] == 3

"""Streams over several files give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import manifest, parsing, partials, sessions, stats
from footfall.plans import ledger
from footfall.session import scratch
from footfall.sinks import commits
from footfall.sources import tables as src
from footfall.sources.access_log import stream_lines
from footfall.sources.notifications import read_notifications
from footfall.streaming import ingest, live, objects, today
from tests.test_parsing import SALT, VIEW_QUERY, line


@pytest.fixture
def stream(spark, views):
    """Page views as a stream of files in time order, one file per micro-batch."""

    def make(rows, files=3):
        path = scratch(spark, "views")
        rows = sorted(rows, key=lambda r: r[1])
        size = -(-len(rows) // files)
        for n in range(files):
            views(rows[n * size:(n + 1) * size]).coalesce(1).write.mode("append").parquet(path)
        batch = spark.read.parquet(path)
        live_rows = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
        return batch, live_rows

    return make


def drain(spark, start, df, label):
    path = scratch(spark, label)
    start(df, path, scratch(spark, "checkpoint"), every=None).awaitTermination()
    return spark.read.parquet(path)


def test_visits_equal_the_batch(spark, stream):
    rng = random.Random(5)
    rows = [(rng.choice("uvw"), f"2024-01-05 {rng.randrange(20):02d}:{rng.randrange(60):02d}:{i % 60:02d}", f"p{i}")
            for i in range(300)]
    # One row of the next day moves the watermark past every visit.
    rows.append(("z", "2024-01-06 12:00:00", "last"))
    batch, live_rows = stream(rows)
    mine = drain(spark, live.append_to, live.stream_sessions(live_rows), "visits")
    key = [*sessions.VISITOR, "session_start_timestamp", "session_end_timestamp", "visit_duration_sec"]
    expected = sessions.sessionize_gap(batch).where("daily_visitor_id <> 'z'").select(key)
    assert sorted(map(str, mine.select(key).collect())) == sorted(map(str, expected.collect()))


def test_hours_and_late_repeats(spark, stream):
    rows = [("u", f"2024-01-05 0{h}:{m:02d}:00", f"p{h}-{m}") for h in range(5) for m in range(0, 60, 7)]
    batch, live_rows = stream(rows + rows)
    clean = live.deduplicated(live_rows, ["page_view_id"])
    assert drain(spark, live.append_to, clean, "dedup").count() == len(rows)
    path = scratch(spark, "hours")
    live.keep_newest(live.hourly_pageviews(live_rows), path, scratch(spark, "checkpoint"), every=None).awaitTermination()
    keys = ["domain_name", "hour_start"]

    def hours():
        return sorted(map(str, live.newest(live.written(spark, path), keys).collect()))

    written = hours()
    assert live.newest(live.written(spark, path), keys).agg(F.sum("page_views_cnt")).first()[0] == 2 * len(rows)
    live.merge_batches(spark, path, keys, before=2, keep=0)
    assert hours() == written and len(src.folders(spark, path)) == 3


def test_returning_visitors_count_once_per_hour(spark, stream):
    rows = [(f"{who}", f"2024-01-05 0{h}:{m:02d}:00", f"p{who}-{h}-{m}")
            for h in range(4) for who, m in [("u", 1), ("v", 20), ("u", 25), ("u", 55), ("w", 58)]]
    batch, live_rows = stream(rows, files=10)
    visitors = drain(spark, live.append_to, live.hourly_visitors(live_rows), "visitors")
    assert sorted((r.hour_start.hour, r.visitor_cnt) for r in visitors.collect()) == [(0, 3), (1, 3)]


def test_closing_step_emits_the_last_hours(spark, stream):
    rows = [(f"{who}", f"2024-01-05 0{h}:{m:02d}:00", f"p{who}-{h}-{m}")
            for h in range(4) for who, m in [("u", 1), ("v", 20), ("u", 25), ("u", 55), ("w", 58)]]
    batch, live_rows = stream(rows, files=10)
    path = scratch(spark, "visitors")
    live.append_to(live.hourly_visitors(live_rows), path, scratch(spark, "checkpoint"), every=None).awaitTermination()
    for _ in range(2):
        closed = live.finish(live.hourly_visitors(batch), path, ["domain_name", "hour_start"])
    assert sorted((r.hour_start.hour, r.visitor_cnt) for r in closed.collect()) == [
        (h, 3) for h in range(4)]


def test_ingest_reads_the_registry_per_batch_and_survives_a_replay(spark):
    source = scratch(spark, "lines")
    good, bad = line(), line(VIEW_QUERY.replace("dk=k1", "dk=k9"))
    for n, texts in enumerate([[good], [good, bad, "short"]]):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(source)
    edges = schemas.empty(spark, schemas.EDGES)
    salts = spark.createDataFrame([SALT], "event_date string, salt string").withColumn(
        "event_date", F.col("event_date").cast("date"))
    calls = []

    def load():
        calls.append(1)
        keys = [("localhost", "k1", None)] + ([("localhost", "k9", None)] if len(calls) > 1 else [])
        return ingest.Dimensions(spark.createDataFrame(keys, schemas.DOMAINS), edges, salts)

    targets = ingest.Targets(scratch(spark, "ingest"))
    ingest.start_ingest(stream_lines(spark, source, 1), load, targets, scratch(spark, "checkpoint"),
                        every=None).awaitTermination()
    assert len(calls) == 2
    assert ingest.stored(spark, targets).count() == 3
    assert spark.read.parquet(targets.rejects).select("error_type").first()[0] == "arity"
    assert spark.read.schema("value string").text(targets.backup).count() == 4
    # The same batch once more changes nothing.
    again = spark.createDataFrame([(good,)], "value string")
    writer = ingest.batch_writer(load, targets)
    writer(again, 7)
    writer(again, 7)
    assert ingest.stored(spark, targets).count() == 4
    # Repeated under a changed registry, a batch leaves no rows of its first run.
    closed = ingest.Dimensions(schemas.empty(spark, schemas.DOMAINS), edges, salts)
    ingest.batch_writer(lambda: closed, targets)(again, 7)
    assert ingest.stored(spark, targets).count() == 3
    writer(again, 7)
    rows = sorted(map(str, ingest.stored(spark, targets).collect()))
    ingest.compact(spark, targets, before=7, keep=0)
    assert sorted(map(str, ingest.stored(spark, targets).collect())) == rows and len(rows) == 4
    assert len(src.folders(spark, targets.incoming)) == 2
    twice = ingest.Targets(scratch(spark, "distinct"))
    ingest.batch_writer(load, twice, distinct=True)(again.union(again), 1)
    assert ingest.stored(spark, twice).count() == 1
    batch = parsing.parse_events(again, *load())
    assert batch.first().page_view_id == ingest.stored(spark, targets).first().page_view_id


class Stop(Exception):
    pass


def lines_of(df):
    return sorted(map(str, df.collect()))


def steps_of_a_merge(monkeypatch):
    """Every call that changes the file system, in order, can be made to stop before or after it."""
    count = {"now": 0, "stop": None}

    def stopping(call):
        def run(*args, **options):
            count["now"] += 1
            if count["stop"] == (count["now"], "before"):
                raise Stop
            result = call(*args, **options)
            if count["stop"] == (count["now"], "after"):
                raise Stop
            return result
        return run

    for name in ("write_json", "remove"):
        monkeypatch.setattr(src, name, stopping(getattr(src, name)))
    return count, stopping


def test_a_merge_that_stops_anywhere_loses_nothing(spark, monkeypatch):
    """Rows are seen exactly once after a stop at each step, after the retry, and after the merge that follows."""
    count, stopping = steps_of_a_merge(monkeypatch)
    write = stopping(lambda rows, path: rows.coalesce(1).write.mode("overwrite").parquet(path))
    steps, k = None, 0
    while steps is None or k < 2 * steps:
        root = scratch(spark, "merge")
        for n in range(4):
            spark.createDataFrame([(n, i) for i in range(3)], "batch int, i int").coalesce(1).write.parquet(f"{root}/batch_id={n}")
        expected = [(n, i) for n in range(4) for i in range(3)]

        def seen():
            return sorted((r.batch, r.i) for r in commits.read(spark, root, "batch int, i int").collect())

        commits.merge(spark, root, 2, write, "batch int, i int", keep=0)
        count.update(now=0, stop=None if steps is None else (k // 2 + 1, ("before", "after")[k % 2]))
        if steps is None:  # the merge that is watched: one merged folder and two batches become two merged folders
            commits.merge(spark, root, 4, write, "batch int, i int", keep=0, together=1)
            steps = count["now"]
            assert seen() == expected and len(commits.state(spark, root).folders) == 1 and commits.batches(spark, root) == []
            continue
        k += 1
        with pytest.raises(Stop):
            commits.merge(spark, root, 4, write, "batch int, i int", keep=0, together=1)
        assert seen() == expected
        count.update(now=0, stop=None)
        commits.merge(spark, root, 4, write, "batch int, i int", keep=0, together=1)
        assert seen() == expected
        commits.clean(spark, root, keep=0)
        assert seen() == expected and commits.batches(spark, root) == []
    assert steps >= 5


def test_readers_of_a_merged_table_finish(spark):
    root, ddl = scratch(spark, "open"), "i int"
    for n in range(3):
        spark.createDataFrame([(n,)], ddl).write.parquet(f"{root}/batch_id={n}")
    reader = commits.read(spark, root, ddl)
    write = lambda rows, path: rows.write.parquet(path)
    commits.merge(spark, root, 2, write, ddl)
    assert sorted(r.i for r in reader.collect()) == [0, 1, 2] == sorted(r.i for r in commits.read(spark, root, ddl).collect())
    # A merged batch that is written again is not seen, and a record is never overwritten.
    spark.createDataFrame([(0,)], ddl).write.mode("overwrite").parquet(f"{root}/batch_id=0")
    assert commits.read(spark, root, ddl).count() == 3
    with pytest.raises(FileExistsError):
        commits.publish(spark, f"{root}/{commits.MERGED}", 1, {})
    assert commits.read(spark, scratch(spark, "none"), ddl).count() == 0


def test_a_line_in_two_batches_counts_once(spark):
    source, targets, checkpoint = scratch(spark, "lines"), ingest.Targets(scratch(spark, "once")), scratch(spark, "checkpoint")
    edges, salts = schemas.empty(spark, schemas.EDGES), spark.createDataFrame([SALT], "event_date string, salt string").withColumn(
        "event_date", F.col("event_date").cast("date"))
    dims = ingest.Dimensions(spark.createDataFrame([("localhost", "k1", None)], schemas.DOMAINS), edges, salts)
    other = line(VIEW_QUERY + "&x=1")
    for texts in ([line()], [line(), other, line()], ["short", line()], [other]):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(source)
        ingest.start_ingest(stream_lines(spark, source, 1), lambda: dims, targets, checkpoint, every=None, once="1 day").awaitTermination()
    assert ingest.stored(spark, targets).count() == 2  # old lines are no reason to drop them
    assert spark.read.schema("value string").text(targets.backup).count() == 3


def test_failed_batches_are_tried_again(spark):
    tried = []

    def write(df, batch):
        tried.append(batch)
        if len(tried) < 3:
            raise Stop

    ingest.patient(write, 3, 0.0)(None, 5)
    assert tried == [5, 5, 5]
    tried.clear()
    with pytest.raises(Stop):
        ingest.patient(write, 2, 0.0)(None, 6)


def test_file_list_of_a_stream(spark):
    """Shuffled and repeated notifications, some of one instant, in many batches."""
    from tests.test_storage import KEY, note

    rng, source, path = random.Random(2), scratch(spark, "notes"), scratch(spark, "files")
    records = [(rng.choice(["ObjectCreated:Put", "ObjectRemoved:Delete"]), f"2023-04-18T01:{rng.randrange(20):02d}:00.000Z",
                KEY.replace("part-1", f"part-{rng.randrange(12)}"), rng.randrange(100), f"{k:04d}") for k in range(150)]
    texts = [note(r) for r in records + rng.sample(records, 60)]
    rng.shuffle(texts)
    for n in range(5):
        spark.createDataFrame(texts[n::5], "value string").coalesce(1).write.mode("append").text(source)
    objects.follow(stream_lines(spark, source, 1), path, scratch(spark, "checkpoint"), every=None).awaitTermination()
    expected = lines_of(manifest.current_files(read_notifications(spark.read.text(source))))
    assert lines_of(objects.files(spark, path)) == expected and expected
    objects.merge(spark, path, before=3)
    objects.merge(spark, path, before=5)
    assert lines_of(objects.files(spark, path)) == expected


def todays_rows(rng, number):
    return [(rng.choice(["u", "v", "w", None]), f"2024-01-05 {rng.randrange(20):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", f"p{k}")
            for k in range(number)]


def test_todays_statistics_equal_the_batch_after_every_file(spark, views):
    """Out of order: later files join, split and move visits of earlier ones; nothing is counted anew."""
    rng, path, place = random.Random(8), scratch(spark, "views"), today.Today(scratch(spark, "today"))
    checkpoint, rows = scratch(spark, "checkpoint"), todays_rows(rng, 160) + [("x", "2024-01-05 03:00:00", "px"), ("x", "2024-01-05 03:00:00", "py")]
    rng.shuffle(rows)
    for n in range(3):
        views(rows[n::3]).withColumn("request_path", F.concat(F.lit("/"), F.crc32("page_view_id") % 3)).withColumn(
            "edge_latitude", (F.crc32("page_view_id") % 7 / 3).cast("float")).coalesce(1).write.mode("append").parquet(path)
        batch = spark.read.parquet(path)
        live_rows = spark.readStream.schema(batch.schema).parquet(path)
        for running in today.start(live_rows, place, checkpoint, every=None):
            running.awaitTermination()
        assert lines_of(today.table(spark, place)) == lines_of(schemas.conform(stats.hourly_stats(batch), schemas.STATS))
    ledger.merge(spark, place.visits, before=2)
    ledger.merge(spark, place.views, before=2)
    assert lines_of(today.table(spark, place)) == lines_of(schemas.conform(stats.hourly_stats(batch), schemas.STATS))
    # Three days on, the timers have dropped the state; a row that comes after that is later than the watermark.
    for day in (8, 9):
        views([("z", f"2024-01-0{day} 12:00:00", f"z{day}")]).coalesce(1).write.mode("append").parquet(path)
        for running in today.start(spark.readStream.schema(batch.schema).parquet(path), place, checkpoint, every=None):
            running.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "slots").load(f"{checkpoint}/visits")
    assert left.count() == 2
    assert lines_of(today.table(spark, place)) == lines_of(schemas.conform(stats.hourly_stats(spark.read.parquet(path)), schemas.STATS))


def test_hot_visitor_is_combined():
    import pandas as pd
    frame = pd.DataFrame([{"domain_name": "d", "event_date": "2024-01-01", "daily_visitor_id": None, "slot": k % 3, "first_us": 100 - k,
                           "last_us": 100 - k, "page_view_id": f"p{k}", "landing": f"l{k}", "ends_ms": 5} for k in range(90)])
    (got,) = today.combined([frame[:40], frame[40:]])
    assert sorted(zip(got["slot"], got["first_us"], got["last_us"], got["landing"])) == [(0, 13, 100, "l87"), (1, 12, 99, "l88"), (2, 11, 98, "l89")]


def test_late_rows_change_their_visitors_only(spark, views):
    rng = random.Random(3)
    rows = todays_rows(rng, 120)
    on_time, late = views(rows[:100]), views([r for r in rows[100:] if r[0] in ("u", None)])
    root = scratch(spark, "ledger")
    ledger.add(partials.of(on_time), root, 0)
    for _ in range(2):  # repeated, it replaces itself
        ledger.add_late(on_time, late, root, 1)
    whole = on_time.unionByName(late)
    assert lines_of(ledger.table(spark, root)) == lines_of(schemas.conform(stats.hourly_stats(whole), schemas.STATS))
    quiet = views([("q", "2024-01-05 23:30:00", "q1")])
    change = partials.late_change(on_time.unionByName(quiet), quiet.withColumn("page_view_id", F.lit("q2")).withColumn(
        "event_timestamp", F.col("event_timestamp") + F.expr("interval 10 seconds")))
    assert [(r.row_sum, r.visit_sum, r.bounce_sum, r.second_sum) for r in change.collect()] == [(1, 0, -1, 10)]
    ledger.merge(spark, root, before=2)
    assert lines_of(ledger.table(spark, root)) == lines_of(schemas.conform(stats.hourly_stats(whole), schemas.STATS))


def test_large_batches_are_parsed_in_parts(spark, monkeypatch):
    """Lines from one task are dealt out before they are cached, also by a stream with state, whose settings stay as they were."""
    source, seen = scratch(spark, "lines"), []
    lines = spark.range(4000).select(F.concat(F.lit(line() + "\t"), *[F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(10)])
                                     .alias("value")).coalesce(1)
    edges = schemas.empty(spark, schemas.EDGES)
    salts = spark.createDataFrame([SALT], "event_date string, salt string").withColumn(
        "event_date", F.col("event_date").cast("date"))
    dims = ingest.Dimensions(spark.createDataFrame([("localhost", "k1", None)], schemas.DOMAINS), edges, salts)
    monkeypatch.setattr(ingest, "PARSED_AT_ONCE", "1m")
    kept = ingest.raw.write_rejects

    def rejects(outcomes, path, **options):
        seen.append((outcomes.rdd.getNumPartitions(), outcomes.sparkSession.conf.get("spark.sql.adaptive.enabled")))
        kept(outcomes, path, **options)

    monkeypatch.setattr(ingest.raw, "write_rejects", rejects)
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    targets = ingest.Targets(scratch(spark, "ingest"))
    ingest.batch_writer(lambda: dims, targets)(lines, 0)
    lines.write.text(source)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        ingest.start_ingest(stream_lines(spark, source), lambda: dims, targets, scratch(spark, "checkpoint"), every=None,
                            once="1 day").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(parts > 1 for parts, _ in seen[:2]) and all(on == "true" for _, on in seen)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == size
    assert ingest.stored(spark, targets).count() + spark.read.parquet(targets.rejects).count() == 4000


def test_salts_of_a_large_table_are_broadcast(spark):
    """Lines without a date never meet in one task."""
    from footfall.operators import dimensions

    hits = spark.range(10).select(F.expr("if(id < 5, null, date_add(date'2024-01-01', int(id)))").alias("event_date"))
    salts = spark.range(10**9).where("id < 7").select(
        F.expr("date_add(date'2024-01-01', int(id))").alias("event_date"), F.col("id").cast("string").alias("salt"))
    plan = dimensions.with_salt(hits, salts)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_digests_of_earlier_batches(spark):
    """Missing and repeated lines, a repeated batch, a pause, and digests that are too old."""
    store = scratch(spark, "digests")

    def taken(texts, batch, at):
        fresh = ingest.first_deliveries(spark.createDataFrame([(t,) for t in texts], "value string"), store, batch, "10 seconds")
        found = sorted(str(r.value) for r in fresh.collect())
        ingest.remember(fresh, store, batch, at * 10**6, "10 seconds")
        return found

    assert taken(["a", None, "a", "b", None], 0, 0) == ["None", "a", "b"]
    for _ in range(2):
        assert taken(["a", "c", None], 1, 5) == ["c"]
    assert taken(["a", "d"], 2, 30) == ["d"]  # no batch has come since
    assert taken(["a", "c", "d"], 3, 31) == ["a", "c"]
    assert src.folders(spark, store) == ["batch=2-at=30000000", "batch=3-at=31000000"]
    with pytest.raises(ValueError):
        ingest._micros(spark, "soon")


def test_lines_once_without_state_and_in_few_tasks(spark, monkeypatch):
    source, targets, checkpoint = scratch(spark, "lines"), ingest.Targets(scratch(spark, "once")), scratch(spark, "checkpoint")
    salts = spark.sql(f"SELECT date'{SALT[0]}' AS event_date, '{SALT[1]}' AS salt")
    edges = spark.sql("SELECT 'HAM' AS edge_id, 'c' AS city, 's' AS state, 'n' AS country, 'de' AS country_code, 1f AS latitude, 2f AS longitude")
    dims = ingest.Dimensions(spark.sql("SELECT 'localhost' AS domain_name, 'k1' AS domain_key, timestamp'2024-01-01' AS created_timestamp"),
                             edges, salts)
    parts, kept = [], ingest.raw.write_rejects

    def rejects(outcomes, path, **options):
        parts.append(outcomes.rdd.getNumPartitions())
        kept(outcomes, path, **options)

    monkeypatch.setattr(ingest.raw, "write_rejects", rejects)
    texts = [line(VIEW_QUERY + f"&x={k}") for k in range(100)]
    for _ in range(2):
        spark.createDataFrame([(t,) for t in texts], "value string").write.mode("append").text(source)
        running = ingest.start_ingest(stream_lines(spark, source), lambda: dims, targets, checkpoint, every=None, once="1 day")
        running.awaitTermination()
        assert list(running.lastProgress["stateOperators"]) == [] and ingest.stored(spark, targets).count() == 100
    assert len(parts) == 2 and max(parts) < 10
    assert "state" not in src.folders(spark, checkpoint) and spark.read.parquet(f"{checkpoint}/digests/*").count() == 100

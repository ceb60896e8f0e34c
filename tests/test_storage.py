"""Stored tables: repeated runs, refreshes, late data, manifest and registry."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import manifest, registry, stats
from footfall.plans import jobs, serving
from footfall.session import scratch
from footfall.sinks import exports, raw
from footfall.sinks import tables as out
from footfall.sources import tables as src
from footfall.sources.access_log import spread, unwrap
from footfall.sources.notifications import read_notifications


def same(a, b):
    b = b.select(a.columns)
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture
def three_days(views):
    rng = random.Random(1)
    rows = [(f"u{rng.randrange(9)}-{day}", f"2024-01-{day:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", f"p{i}")
            for i, day in enumerate(rng.choices([1, 2, 3], k=200))]
    v = views(rows)
    return v.withColumns({
        "event_type": F.when(F.crc32("page_view_id") % 5 == 0, "event").otherwise("pageview"),
        "event_name": F.lit("signup"), "event_data": F.lit("{}"),
        "arrival_timestamp": F.col("event_timestamp") + F.expr("interval 1 day") * (F.crc32("page_view_id") % 2)})


def test_nightly_and_hourly_runs_can_be_repeated(spark, three_days):
    layout = jobs.Layout(scratch(spark, "jobs"))
    first, second, third = (dt.date(2024, 1, d) for d in (1, 2, 3))
    assert serving.high_water_mark(spark, layout.history) is None
    assert jobs.nightly(spark, three_days, layout, second) == [first]
    assert jobs.nightly(spark, three_days, layout, third) == [second]
    assert serving.high_water_mark(spark, layout.history) == second
    once = sorted(map(str, serving.read_history(spark, layout.history).collect()))
    # A repeated night writes its own day, and nothing else.
    kept = src.files_of_days(spark, serving.versions(spark, layout.history)[-1], [first])
    assert jobs.nightly(spark, three_days, layout, third) == [second]
    assert src.files_of_days(spark, serving.versions(spark, layout.history)[-1], [first]) == kept
    assert sorted(map(str, serving.read_history(spark, layout.history).collect())) == once
    assert same(serving.read_history(spark, layout.history), stats.daily_stats(three_days).where("event_date < '2024-01-03'"))
    assert src.curated_events(spark, layout.events).count() == three_days.where(
        "event_type = 'event' and event_date < '2024-01-03'").count()
    for _ in range(2):
        jobs.hourly(three_days, layout, third)
    today = src.stats_today(spark, layout.today, third)
    assert same(serving.serve(serving.read_history(spark, layout.history), today), stats.daily_stats(three_days))


def test_late_days_only(spark, three_days):
    path, events = scratch(spark, "late"), scratch(spark, "late-events")
    cutoff = "2024-01-03 00:00:00"
    on_time = three_days.where(F.col("arrival_timestamp") < cutoff)
    serving.recompute(on_time, [dt.date(2024, 1, d) for d in (1, 2, 3)], path, events, "boundary")
    late = serving.touched_days(three_days, cutoff)
    assert {str(r[0]) for r in late.collect()} == {"2024-01-02", "2024-01-03"}
    assert serving.reprocess(three_days, cutoff, path, events, "boundary") == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    assert same(src.stats(spark, path), stats.daily_stats(three_days, mode="boundary"))
    assert same(src.curated_events(spark, events), stats.curated_events(three_days))


def test_late_data_is_served(spark, three_days):
    layout = jobs.Layout(scratch(spark, "late-served"))
    cutoff, fourth = "2024-01-03 00:00:00", dt.date(2024, 1, 4)
    on_time = three_days.where(F.col("arrival_timestamp") < cutoff)
    for day in (2, 3):
        jobs.nightly(spark, on_time, layout, dt.date(2024, 1, day))
    assert jobs.nightly(spark, three_days, layout, fourth, since=cutoff) == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    assert same(serving.read_history(spark, layout.history), stats.daily_stats(three_days))
    assert same(src.curated_events(spark, layout.events), stats.curated_events(three_days))


def test_partitions_without_rows_go(spark, three_days):
    path = scratch(spark, "stale")
    day = dt.date(2024, 1, 1)
    two = three_days.withColumn("domain_name", F.when(F.crc32("page_view_id") % 3 == 0, "b.example").otherwise("a.example"))
    serving.recompute(two, [day], path)
    serving.recompute(two.where("domain_name = 'a.example'"), [day], path)
    assert same(src.stats(spark, path), stats.daily_stats(two.where("domain_name = 'a.example'"), day))
    serving.recompute(two.limit(0), [day], path)
    assert src.stats(spark, path).count() == 0


def test_readers_keep_their_version(spark, three_days):
    source, history = scratch(spark, "source"), scratch(spark, "history")
    assert serving.read_history(spark, history).count() == 0
    out.write_stats(stats.daily_stats(three_days), source)
    serving.refresh_full(spark, source, history)
    reader = serving.read_history(spark, history)
    rows = reader.count()
    serving.refresh_full(spark, source, history, dt.date(2024, 1, 2))
    assert reader.count() == rows  # still the version it opened
    assert serving.read_history(spark, history).count() < rows
    out.write_stats(stats.daily_stats(three_days), f"{history}/v000009")
    src.remove(spark, f"{history}/v000009/_SUCCESS")  # a rebuild that did not finish
    assert serving.read_history(spark, history).count() < rows
    serving.refresh_full(spark, source, history)
    assert serving.read_history(spark, history).count() == rows and len(serving.versions(spark, history)) == 2


def test_snapshots_share_days_and_survive_a_stop(spark, three_days, monkeypatch):
    source, history = scratch(spark, "source"), scratch(spark, "snapshots")
    first, second, third = (dt.date(2024, 1, d) for d in (1, 2, 3))
    table = stats.daily_stats(three_days)
    out.write_stats(table, source)
    assert serving.refresh_history(spark, source, history, third) == [first, second]
    one, reader = serving.snapshot(spark, history), serving.read_history(spark, history)
    before = sorted(map(str, reader.collect()))
    out.replace_days(table.where(F.col("event_hour") < 12), source, out.write_stats, [first, second, third])

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(src, "write_json", stop)
        with pytest.raises(OSError):
            serving.refresh_history(spark, source, history, third, [second])
    assert serving.snapshot(spark, history) == one and sorted(map(str, serving.read_history(spark, history).collect())) == before
    assert serving.refresh_history(spark, source, history, third, [second]) == [second]
    two = serving.snapshot(spark, history)
    assert two.days[first] == one.days[first] and two.days[second] != one.days[second]
    # The reader that opened before the refresh finishes on the old days; a new one sees the new day and the shared one.
    assert sorted(map(str, reader.collect())) == before
    assert sorted(map(str, serving.read_history(spark, history, one.number).collect())) == before
    assert same(serving.read_history(spark, history), table.where(
        (F.col("event_date") == F.lit(first)) | ((F.col("event_date") == F.lit(second)) & (F.col("event_hour") < 12))))
    # The folder that the stopped refresh left goes with the next one, and the first snapshot's own day with the one after that.
    assert len([n for n in src.folders(spark, history) if n.startswith("version=")]) == 2
    serving.refresh_history(spark, source, history, third, [second])
    assert src.files_of_days(spark, f"{history}/{one.days[second]}", [second]) == {}
    assert src.files_of_days(spark, f"{history}/{one.days[first]}", [first]) != {}
    with pytest.raises(FileNotFoundError):
        serving.read_history(spark, history, one.number)
    plan = serving.read_history(spark, history).where("event_date = '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and plan.count("FileScan") == 1


def test_repeated_deliveries(spark, three_days):
    layout, third = jobs.Layout(scratch(spark, "repeats")), dt.date(2024, 1, 3)
    twice = three_days.union(three_days)
    jobs.nightly(spark, twice, layout, third, distinct=True)
    jobs.hourly(twice, layout, third, distinct=True)
    assert same(serving.read_history(spark, layout.history), stats.daily_stats(three_days, dt.date(2024, 1, 2)))
    assert same(src.stats(spark, layout.today), stats.daily_stats(three_days, third))


def test_day_filters_prune_partitions(spark, three_days):
    path = scratch(spark, "stats")
    out.write_stats(stats.daily_stats(three_days), path)
    plan = src.stats_between(spark, path, "2024-01-01", "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_has_data_and_empty_table(spark, three_days):
    assert src.has_data(three_days, "2024-01-01") and not src.has_data(three_days, "2024-01-09")
    empty = schemas.empty(spark, schemas.STATS)
    assert empty.columns == schemas.names(schemas.STATS) and empty.count() == 0
    src.create_stats_table(spark, "declared_stats")
    assert sorted(spark.table("declared_stats").columns) == sorted(schemas.names(schemas.STATS))
    assert serving.serve(stats.daily_stats(three_days)).count() == stats.daily_stats(three_days).count()


def test_csv_keeps_every_value(spark):
    values = ["", None, '"', '""', "a;b", "c\\d", '\\"', "e\nf", "g\r\nh", " i ", "\t", "#j", "\\N", "null", "'"]
    rows = [("a.example", k, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "domain_name string, event_hour int, request_path string").withColumn(
        "event_date", F.lit("2024-01-01").cast("date"))
    path = scratch(spark, "special")
    exports.export_csv(df, path)
    got = exports.read_csv(spark, path, "domain_name string, event_hour int, request_path string, event_date date")
    assert {r.event_hour: r.request_path for r in got.collect()} == dict(enumerate(values))


def test_dimensions_fold_repeated_keys(spark):
    from footfall.operators import dimensions
    events = spark.createDataFrame([("HAM", "2024-01-01"), ("SFO", "2024-01-02")], "edge_id string, event_date string").withColumn(
        "event_date", F.col("event_date").cast("date"))
    edge = ("HAM", "B", "s", "c", "cc", 1.0, 2.0)
    edges = spark.createDataFrame([edge, ("HAM", "A", *edge[2:]), edge], schemas.EDGES)
    salts = spark.createDataFrame([("2024-01-01", "x"), ("2024-01-01", "x"), ("2024-01-02", "x"), ("2024-01-02", "y")],
                                  "event_date string, salt string").withColumn("event_date", F.col("event_date").cast("date"))
    for parts in (edges, edges.orderBy("city")):
        assert {r.edge_id: r.edge_city for r in dimensions.with_location(events, parts).collect()} == {"HAM": "A", "SFO": None}
    assert {r.edge_id: r.salt for r in dimensions.with_salt(events, salts).collect()} == {"HAM": "x", "SFO": None}
    changes = spark.createDataFrame([("d", "k1", "2024-01-01"), ("d", "k2", "2024-01-03"), ("d", "k3", "2024-01-02")],
                                    "domain_name string, domain_key string, t string").selectExpr(
        "domain_name", "domain_key", "cast(t as timestamp) as created_timestamp")
    assert [r.domain_key for r in registry.upsert(changes.limit(0), changes).collect()] == ["k2"]


def test_csv_export(spark, three_days):
    table = stats.daily_stats(three_days)
    name = exports.export_name("a.example", "2024-01-01", "2024-01-03")
    assert name == "stats_a_example_2024-01-01_2024-01-03.csv"
    path = f"{scratch(spark, 'csv')}/{name}"
    exports.export_csv(table, path)
    first = spark.read.text(path).first()[0]
    assert first == ";".join(table.columns)
    assert same(exports.read_csv(spark, path, schemas.STATS), schemas.conform(table, schemas.STATS))


def test_arrow_chunks_reach_a_client(spark, three_days):
    import pyarrow as pa

    table = stats.daily_stats(three_days)
    total = sum(pa.ipc.open_stream(body).read_all().num_rows for body in exports.arrow_stream(table))
    assert total == table.count()


def test_backup_keeps_every_line(spark):
    lines = spark.createDataFrame([("1700000000.1\ta",), ("garbage",), ("",)], "value string")
    path = scratch(spark, "raw")
    for _ in range(2):
        raw.write_backup(lines, path, batch=0)
    stored = spark.read.schema("value string").text(path)
    assert sorted(r.value for r in stored.select("value").collect()) == ["", "1700000000.1\ta", "garbage"]


def test_wrapped_lines(spark):
    rows = spark.createDataFrame([("YQli",), ("not base64!",)], "data string")
    assert [r.value for r in unwrap(rows).collect()] == ["a\tb", None]
    assert spread(rows.coalesce(1)).count() == 2


def note(*records):
    message = json.dumps({"Records": [
        {"eventName": name, "eventTime": time, "s3": {"bucket": {"name": "b"}, "object": {
            "key": key, "size": size, "sequencer": seq}}} for name, time, key, size, seq in records]})
    return (json.dumps({"Records": [{"EventSource": "x", "Sns": {"Message": message}}]}),)


KEY = "incoming/domain_name%3Dmydomain.com/event_type=pageview/event_date=2022-11-29/part-1.parquet"


def test_manifest_follows_the_newest_notification(spark):
    made, gone = "ObjectCreated:Put", "ObjectRemoved:Delete"
    other = KEY.replace("part-1", "part-2")
    third = KEY.replace("part-1", "part-3")
    notes = spark.createDataFrame([
        note((made, "2023-04-18T01:24:48.724Z", KEY, 1, "01"), (made, "2023-04-18T01:24:48.724Z", other, 2, "01")),
        note((gone, "2023-04-18T01:25:00.000Z", KEY, 0, "02")),
        note((made, "2023-04-18T01:26:00.000Z", KEY, 9999, "03")),
        note((gone, "2023-04-18T01:26:00.000Z", other, 0, "02")),
        note((made, "2023-04-18T01:26:00.000Z", third, 3, "01"), (gone, "2023-04-18T01:26:00.000Z", third, 0, "02")),
        note((made, "2023-04-18T01:26:00.000Z", "elsewhere/x", 3, "01")),
        ("broken",), ("{}",)], "value string")
    (row,) = manifest.current_files(read_notifications(notes)).collect()
    assert (row.file_type, row.file_sub_type, row.file_domain_name, str(row.file_event_date), row.file_name,
            row.file_size, row.s3_bucket, row.s3_key) == (
        "cleaned", "pageview", "mydomain.com", "2022-11-29", "part-1.parquet", 9999, "b", KEY.replace("%3D", "="))
    assert str(row.file_created_timestamp) == "2023-04-18 01:26:00"


def test_today_changed(spark):
    key = "aggregated/daily-stats/event_date=2024-01-01/event_hour=7/s.parquet"
    notes = spark.createDataFrame([note(("ObjectCreated:Put", "2024-01-01T08:00:00Z", key, 1, "1"))], "value string")
    files = manifest.current_files(read_notifications(notes))
    assert manifest.today_changed(files, "2024-01-01", None)
    assert not manifest.today_changed(files, "2024-01-01", 1)
    assert manifest.list_files(files, "2024-01-02", manifest.today_prefix("2024-01-02")).count() == 0


def test_registry(spark):
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "domain_name string")
    first = registry.new_keys(names, "2024-01-01", seed="s")
    assert first.count() == 2 and first.select("domain_key").distinct().count() == 2
    again = registry.new_keys(names.where("domain_name = 'a'"), "2024-02-01")
    after = registry.upsert(first, again)
    assert [r.domain_name for r in registry.list_domains(after).collect()] == ["b", "a"]
    assert [r.domain_name for r in registry.list_domains(after, oldest_first=True).collect()] == ["b", "a"]
    assert registry.get_domain(after, "a").first().domain_key == again.first().domain_key
    assert [r.domain_name for r in registry.delete(after, names.where("domain_name = 'b'")).collect()] == ["a"]

"""Scans of the stored tables; day and range filters prune partitions."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schemas


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, place = _at(spark, path)
    if not fs.rename(place, _at(spark, to)[1]):
        raise OSError(f"{path} could not become {to}")


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders below a path (a pattern may name several); none if it doesn't exist."""
    fs, place = _at(spark, f"{pattern}/*")
    return [s.getPath().getName() for s in fs.globStatus(place) or [] if s.isDirectory()]


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if it doesn't exist."""
    fs, place = _at(spark, f"{path}/*")
    return [s.getPath().getName() for s in fs.globStatus(place) or [] if s.isFile()]


def read_json(spark: SparkSession, path: str):
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, body) -> None:
    """Write a file that is whole once it is there; FileExistsError if there is one."""
    folder, name = path.rsplit("/", 1)
    fs, hidden = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(hidden, True)
    stream.write(bytearray(json.dumps(body).encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.NONE  # unlike the file system's own rename, this never overwrites
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(hidden, _at(spark, path)[1], how)
    except Py4JJavaError as error:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            raise FileExistsError(path) from error
        raise


def files_of_days(spark: SparkSession, path: str, days) -> dict[str, set[str]]:
    """Names of the files in each partition folder of some dates."""
    found: dict[str, set[str]] = {}
    fs, place = _at(spark, f"{path}/{{*/,}}event_date={{{','.join(map(str, days))},}}")
    for folder in fs.globStatus(place) or []:
        inside = fs.listFiles(folder.getPath(), True)
        while inside.hasNext():
            file = inside.next().getPath()
            found.setdefault(file.getParent().toString(), set()).add(file.getName())
    return found


def stored_dates(spark: SparkSession, path: str) -> set[dt.date]:
    """Dates of a table partitioned by domain and date, from the names of its folders."""
    names = {n for n in folders(spark, f"{path}/domain_name=*") if n.startswith("event_date=")}
    return {dt.date.fromisoformat(n.split("=", 1)[1]) for n in names if "__HIVE" not in n}


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(path).select(*schemas.names(ddl))


def incoming(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.INCOMING)


def of_day(events: DataFrame, kind: str, day) -> DataFrame:
    """Cleaned events of one type and date; both are partition columns."""
    return events.where((F.col("event_type") == kind) & (F.col("event_date") == F.lit(day).cast("date")))


def pageviews_of_day(events: DataFrame, day) -> DataFrame:
    return of_day(events, "pageview", day)


def events_of_day(events: DataFrame, day) -> DataFrame:
    return of_day(events, "event", day)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """The whole statistics history (also the layout of today's statistics)."""
    return read_table(spark, path, schemas.STATS)


def stats_between(spark: SparkSession, path: str, start, end) -> DataFrame:
    """History of a date range, both ends included."""
    return stats(spark, path).where(
        F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def stats_today(spark: SparkSession, path: str, run_date) -> DataFrame:
    """Today's statistics; older dates in the folder are not read."""
    return stats(spark, path).where(F.col("event_date") == F.lit(run_date).cast("date"))


def curated_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.EVENTS)


def probe(events: DataFrame, day) -> DataFrame:
    """At most one row, present when the day has page views."""
    return pageviews_of_day(events, day).select("event_date").limit(1)


def has_data(events: DataFrame, day) -> bool:
    return not probe(events, day).isEmpty()


def create_stats_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Declare the statistics table in the catalog."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schemas.STATS}) USING parquet "
              f"PARTITIONED BY (domain_name, event_date){where}")

"""Access-log lines, from files or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of text files; compressed files are read one task each."""
    return spark.read.text(path)


def spread(lines: DataFrame) -> DataFrame:
    """Share lines over all cores when the scan gives fewer tasks than there are cores.

    That happens with few compressed files; scans with enough tasks are left alone.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines if lines.rdd.getNumPartitions() >= cores else lines.repartition(cores)


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Log lines arriving as new text files of a folder."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, source: str = "kafka") -> DataFrame:
    """Log lines arriving on a message topic (needs the connector on the class path)."""
    records = (spark.readStream.format(source).option("kafka.bootstrap.servers", servers)
               .option("subscribe", topic).load())
    return records.select(F.col("value").cast("string").alias("value"))


def unwrap(records: DataFrame, data: str = "data") -> DataFrame:
    """Lines that travel base64-encoded; undecodable records give NULL."""
    return records.select(F.decode(F.try_to_binary(F.col(data), F.lit("base64")), "UTF-8").alias("value"))

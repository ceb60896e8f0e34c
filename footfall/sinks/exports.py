"""Exports of report data."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

EXPORT_ORDER = ["domain_name", "event_date", "event_hour"]


def export_name(domain: str, start, end, prefix: str = "stats") -> str:
    return f"{prefix}_{domain.replace('.', '_')}_{start}_{end}.csv"


# Quotes are doubled; NULL is an empty field, an empty text is two quotes; nothing is trimmed.
_CSV = {"header": True, "sep": ";", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False}
_ABSENT = "\x01absent\x01"  # what the reader takes an empty field for; never written


def export_csv(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, ``;`` as delimiter, ordered over all part files of the folder."""
    (stats.orderBy(*EXPORT_ORDER).write.mode(mode)
     .options(**_CSV, nullValue="", emptyValue='""').csv(path))


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Values may hold line breaks, so a part file is read by one task."""
    return spark.read.schema(ddl).options(**_CSV, nullValue=_ABSENT, emptyValue="", multiLine=True).csv(path)


def to_arrow_chunks(df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """The rows as Arrow IPC streams, one self-contained stream per batch.

    Encoding runs on the executors; a client can take the chunks one by one with
    ``toLocalIterator`` while the job is still running.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            body = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], [chunk])

    return df.mapInArrow(encode, f"{chunk} binary")


def from_arrow_chunks(chunks: DataFrame, ddl: str, chunk: str = "chunk") -> DataFrame:
    """Rows of Arrow IPC streams made by ``to_arrow_chunks``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                with pa.ipc.open_stream(body) as reader:
                    yield from reader

    return chunks.select(chunk).mapInArrow(decode, ddl)


def arrow_stream(df: DataFrame) -> Iterator[bytes]:
    """Arrow IPC chunks for a client, fetched partition by partition."""
    for row in to_arrow_chunks(df).toLocalIterator(prefetchPartitions=True):
        yield bytes(row[0])

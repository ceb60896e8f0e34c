"""Raw backups and rejected lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import times, urls

# Compressed text cannot be split when read, so files are kept small.
RECORDS_PER_FILE = 2_000_000


def arrival_date(line: Column) -> Column:
    """Date of a line's first field; NULL when it is no time."""
    return F.to_date(times.from_seconds(urls.leading_int(F.substring_index(line, "\t", 1))))


def write_backup(lines: DataFrame, path: str, value: str = "value", mode: str = "append",
                 batch: int | None = None) -> None:
    """Every incoming line, compressed, by arrival date.

    A ``batch`` number makes writing the same batch again replace its earlier copy.
    """
    rows = lines.select(F.col(value).alias("value"), arrival_date(F.col(value)).alias("arrival_date"))
    _write(rows, path, ["arrival_date"], "text", mode, batch)


def write_rejects(outcomes: DataFrame, path: str, mode: str = "append", batch: int | None = None) -> None:
    """Rejected lines by arrival date and kind of error."""
    rows = outcomes.where(F.col("result") != "Ok").select(
        "value", "message", arrival_date(F.col("value")).alias("error_date"),
        F.col("error").alias("error_type"))
    _write(rows, path, ["error_date", "error_type"], "parquet", mode, batch)


def _write(rows: DataFrame, path: str, by: list[str], kind: str, mode: str, batch: int | None) -> None:
    if batch is not None:  # a folder of its own, replaced as a whole
        path, mode = f"{path}/batch_id={batch}", "overwrite"
    writer = (rows.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode)
              .option("partitionOverwriteMode", "static" if batch is not None else "dynamic").partitionBy(*by)
              .option("maxRecordsPerFile", RECORDS_PER_FILE))
    writer.option("compression", "gzip" if kind == "text" else "snappy").format(kind).save(path)

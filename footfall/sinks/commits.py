"""Commit records: what readers of a growing table see changes with one rename.

A record is a small JSON file with a number. It is written beside its place and moved there without overwriting, so of two writers of one
number one fails, and a writer that stops leaves the whole record or none. Readers take the newest. The file system must have such a
rename, as for the checkpoints of Spark's streams.

A table of batches is a folder with ``batch_id=N`` folders. Its record names the merged folders below ``_merged`` and the number below
which batches count as merged: readers see the merged folders and the batches from that number on. Merging writes a new folder, which
nobody sees, then the record. A merge that stops at any step leaves either the old state or the new one; what it left behind is removed
by a later merge. Folders that a record replaced stay for ``keep`` more merges, so readers that opened the table before finish.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from footfall import schemas
from footfall.sources import tables as src

MERGED = "_merged"
TOGETHER = 8  # merged folders that are merged again


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the records in a folder, in order."""
    return sorted(int(n[:6]) for n in src.files(spark, folder) if re.fullmatch(r"\d{6}\.json", n))


def record(spark: SparkSession, folder: str, number: int) -> dict:
    return src.read_json(spark, f"{folder}/{number:06d}.json")


def publish(spark: SparkSession, folder: str, number: int, body: dict) -> None:
    """Write a record; FileExistsError if its number is taken."""
    src.write_json(spark, f"{folder}/{number:06d}.json", body)


def forget(spark: SparkSession, folder: str, keep: int) -> None:
    """Remove all records but the last ``keep``."""
    for number in numbers(spark, folder)[:-keep]:
        src.remove(spark, f"{folder}/{number:06d}.json")


class State(NamedTuple):
    """What a table of batches consists of."""

    number: int
    below: int
    folders: tuple[str, ...]


def state(spark: SparkSession, root: str, back: int = 0) -> State:
    """The newest state, or that of ``back`` records before it."""
    known = numbers(spark, f"{root}/{MERGED}")
    if len(known) <= back:
        return State(0, 0, ())
    body = record(spark, f"{root}/{MERGED}", known[-1 - back])
    return State(known[-1 - back], body["below"], tuple(body["folders"]))


def batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batch folders, merged or not."""
    return sorted(int(n.split("=")[1]) for n in src.folders(spark, root) if re.fullmatch(r"batch_id=\d+", n))


def _rows(spark: SparkSession, root: str, ids: list[int], folders: tuple[str, ...], ddl: str | None) -> DataFrame | None:
    """The rows of some batches and merged folders, with the layout given or, if there is none, with their ``batch_id``."""
    places = [(root, [f"{root}/batch_id={n}" for n in ids])] if ids else []
    places += [(f"{root}/{MERGED}/{f}", [f"{root}/{MERGED}/{f}"]) for f in folders]
    found = None
    for base, paths in places:
        reader = spark.read if ddl is None else spark.read.schema(ddl)
        rows = reader.option("basePath", base).parquet(*paths)
        rows = rows if ddl is None else rows.select(*schemas.names(ddl))
        found = rows if found is None else found.unionByName(rows)
    return found


def read(spark: SparkSession, root: str, ddl: str | None = None) -> DataFrame:
    """All rows, each once; without a layout they have the column ``batch_id``, and there must be a batch."""
    now = state(spark, root)
    found = _rows(spark, root, [n for n in batches(spark, root) if n >= now.below], now.folders, ddl)
    if found is None:
        if ddl is None:
            raise FileNotFoundError(root)
        return schemas.empty(spark, ddl)
    return found


def merge(spark: SparkSession, root: str, before: int, write: Callable[[DataFrame, str], None], ddl: str | None = None,
          keep: int = 1, together: int = TOGETHER) -> None:
    """Put the batches below a number into one folder; ``write`` gets their rows and a path.

    Only batches that can no longer be repeated may be given; a batch that is written again all the same is not seen. Merged folders
    are merged again once there are ``together`` of them, so a row is rewritten a number of times that grows with the logarithm.
    """
    now = state(spark, root)
    ids = [n for n in batches(spark, root) if now.below <= n < before]
    again = now.folders if len(now.folders) >= together else ()
    if len(ids) + len(again) > 1:
        name = f"c{now.number + 1:06d}-{uuid.uuid4().hex[:8]}"
        write(_rows(spark, root, ids, again, ddl), f"{root}/{MERGED}/{name}")
        left = tuple(f for f in now.folders if f not in again)
        publish(spark, f"{root}/{MERGED}", now.number + 1, {"below": max(now.below, before), "folders": [*left, name]})
    clean(spark, root, keep)


def clean(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Remove what neither the newest state nor the ``keep`` before it consist of.

    A merged folder that no record names may belong to a merge that still runs; it goes once a record with its number exists.
    """
    kept = [state(spark, root, back) for back in range(keep + 1)]
    for n in batches(spark, root):
        if n < kept[-1].below:
            src.remove(spark, f"{root}/batch_id={n}")
    for name in src.folders(spark, f"{root}/{MERGED}"):
        made = re.fullmatch(r"c(\d{6})-\w+", name)
        if made and int(made[1]) <= kept[0].number and not any(name in s.folders for s in kept):
            src.remove(spark, f"{root}/{MERGED}/{name}")
    forget(spark, f"{root}/{MERGED}", keep + 1)

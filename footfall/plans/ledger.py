"""The statistics table as a ledger: a folder of partials for each change, added up when it is read.

A change is the page views of a batch, the visits that a stream has corrected, or what late lines change (``partials``). Adding a change
again under its number replaces it, so a job that is repeated counts nothing twice. Merging adds up old changes (``commits``); a reader
then adds up one row per group and the newest changes. Days are partitions, so a range reads its days only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall import schemas
from footfall.operators import partials
from footfall.operators.sessions import GAP_SECONDS
from footfall.sinks import commits
from footfall.sinks import tables as out

LAYOUT = ", ".join([p.strip() for p in schemas.STATS.split(",") if p.split()[0] in schemas.DIMS] + [f"{c} bigint" for c in partials.SUMS])


def _write(parts: DataFrame, path: str) -> None:
    out.write_partitions(schemas.conform(parts, LAYOUT), path, ["event_date", "domain_name"], ["event_hour"], whole=True)


def add(parts: DataFrame, root: str, number: int) -> None:
    """Store a change under a number; an earlier change of that number goes."""
    _write(partials.summed(parts), f"{root}/batch_id={number}")


def changes(spark: SparkSession, root: str) -> DataFrame:
    """All partials, merged or not."""
    return commits.read(spark, root, LAYOUT)


def table(spark: SparkSession, *roots: str) -> DataFrame:
    """The statistics table of one or more ledgers together."""
    found = changes(spark, roots[0])
    for root in roots[1:]:
        found = found.unionByName(changes(spark, root))
    return partials.table(found)


def merge(spark: SparkSession, root: str, before: int, keep: int = 1) -> None:
    """Add up the changes below a number, which must not be added again."""
    commits.merge(spark, root, before, lambda rows, path: _write(partials.summed(rows), path), LAYOUT, keep)


def add_late(before: DataFrame, late: DataFrame, root: str, number: int, gap: int = GAP_SECONDS) -> None:
    """Store what late page views change; ``before`` are the page views that the ledger counts already."""
    add(partials.late_change(before, late, gap), root, number)

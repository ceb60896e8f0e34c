"""Visitors over any range of days and any dimensions, from sketches that are stored once.

Distinct visitors of several days or groups are no sum. A sketch of each stored group holds 2^``PRECISION`` registers at most (a few
values are kept as they are); the sketch of a range or of coarser dimensions is the union of its groups' sketches. Adding a visitor
again changes nothing, so late or re-delivered page views are added to a stored day without reading that day's page views.

The standard error of a union is ``error()``, 0.8 % for 2^14 registers. ``between`` gives the interval of three standard errors around its
estimate. Rows without a visitor count nothing; a group whose rows all lack one has 0 visitors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 14
DEVIATIONS = 3
DIMS = ("domain_name", "event_date", "browser_name", "device_type", "edge_country")
SKETCH = "visitor_sketch"


def error(precision: int = PRECISION) -> float:
    """The relative standard error of merged sketches."""
    return 1.04 / math.sqrt(2**precision)


def sketches(views: DataFrame, dims: Sequence[str] = DIMS, visitor: str = "daily_visitor_id", precision: int = PRECISION) -> DataFrame:
    """One sketch of the visitors of each group."""
    # Empty texts are visitors too, which the sketch would pass over, so it takes a number for each.
    seen = F.when(F.col(visitor).isNotNull(), F.xxhash64(F.col(visitor).cast("string")))
    return views.groupBy(*dims).agg(F.hll_sketch_agg(seen, precision).alias(SKETCH))


def merged(stored: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups; ``dims`` are some of the stored dimensions, or none."""
    return stored.groupBy(*dims).agg(F.hll_union_agg(SKETCH).alias(SKETCH))


def added(stored: DataFrame, views: DataFrame, dims: Sequence[str] = DIMS, visitor: str = "daily_visitor_id",
          precision: int = PRECISION) -> DataFrame:
    """Stored sketches with further page views in them; groups that got none keep their sketch."""
    return merged(stored.select(*dims, SKETCH).unionByName(sketches(views, dims, visitor, precision)), dims)


def between(stored: DataFrame, start, end, dims: Sequence[str] = ("domain_name",), precision: int = PRECISION) -> DataFrame:
    """(dims, visitors, visitors_low, visitors_high) of the days from ``start`` to ``end``, both inclusive."""
    rows = stored.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    found = merged(rows, dims).withColumn("visitors", F.hll_sketch_estimate(SKETCH))
    wide = DEVIATIONS * error(precision)
    low, high = F.floor(F.col("visitors") / (1 + wide)), F.ceil(F.col("visitors") / (1 - wide))
    return found.select(*dims, "visitors", low.cast("bigint").alias("visitors_low"), high.cast("bigint").alias("visitors_high"))

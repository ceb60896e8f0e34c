"""Previous and next row of the same key, safe for very hot keys.

A plain window over the key would sort one key's rows in one task. Here rows are
first ordered inside short time slices of the key; only the first and last row of
a slice can have a neighbour elsewhere, and just those few rows are ordered over
the whole key. Both branches read the same shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(df: DataFrame, keys: Sequence[str], ts: str = "event_timestamp",
                    tie: str = "page_view_id", slice_seconds: float = 60.0,
                    prev: str = "prev", following: str = "next") -> DataFrame:
    """Add structs ``prev`` and ``next`` holding (ts, tie) of the adjacent rows.

    Rows of a key are ordered by ``(ts, tie)``; ends have NULL. The work per task is
    bounded by one key's rows within a slice and by two rows per slice of a key.
    """
    width = int(slice_seconds * 1_000_000)
    me = F.struct(F.col(ts).alias(ts), F.col(tie).alias(tie))
    order = [F.col(ts), F.col(tie)]
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*order)

    sliced = df.withColumn("_slice", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / width))
    local = sliced.withColumns({prev: F.lag(me).over(inside), following: F.lead(me).over(inside)})
    at_edge = F.col(prev).isNull() | F.col(following).isNull()
    edges = local.where(at_edge).withColumns({
        "_before": F.lag(me).over(across), "_after": F.lead(me).over(across)})
    edges = edges.withColumn(prev, F.coalesce(prev, "_before")).withColumn(
        following, F.coalesce(following, "_after"))
    return local.where(~at_edge).unionByName(edges.drop("_before", "_after")).drop("_slice")

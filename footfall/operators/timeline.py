"""The registry of domains in time: which key a domain had when a line was written.

``changes`` is (domain_name, domain_key, changed_at, deleted): a put gives the domain its key from that moment on, a deletion takes it away.
Of several changes of a domain at one moment a put wins over a deletion, and of puts the one with the largest key. Changes without a
domain or a moment are left out.

Time is cut into slices. A domain's changes inside a slice are one short ordered list next to the key that it had when the slice began, so
lines find their key by an equality join on (domain, slice) and a look into that list. What is ordered over a whole domain is one row
for each slice, never its changes or its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.dimensions import broadcast_if_small

SLICE_SECONDS = 3600


def _slice(moment: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(moment.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def settled(changes: DataFrame) -> DataFrame:
    """(domain_name, changed_at, domain_key): one row for each domain and moment; the key is NULL from a deletion on."""
    live = F.when(~F.coalesce("deleted", F.lit(False)), F.col("domain_key"))
    known = changes.where(F.col("domain_name").isNotNull() & F.col("changed_at").isNotNull())
    return known.groupBy("domain_name", F.col("changed_at").cast("timestamp").alias("changed_at")).agg(F.max(live).alias("domain_key"))


def slices(changes: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """(domain_name, slice, steps): the changes of each domain and slice, (changed_at, domain_key) in order of time."""
    steps = F.sort_array(F.collect_list(F.struct("changed_at", "domain_key")))
    return settled(changes).groupBy("domain_name", _slice(F.col("changed_at"), seconds).alias("slice")).agg(steps.alias("steps"))


def intervals(changes: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """(domain_name, domain_key, valid_from, valid_to): when a domain had which key; the end is exclusive, NULL for now.

    Puts that repeat the key start an interval of their own; times without a key have none.
    """
    rows = slices(changes, seconds)
    over = Window.partitionBy("domain_name").orderBy("slice")
    rows = rows.withColumn("next", F.lead(F.col("steps")[0]["changed_at"]).over(over))
    ends = F.concat(F.transform(F.slice("steps", 2, F.size("steps")), lambda s: s["changed_at"]), F.array("next"))
    pairs = F.transform(F.arrays_zip("steps", ends.alias("ends")), lambda p: F.struct(
        p["steps"]["domain_key"].alias("domain_key"), p["steps"]["changed_at"].alias("valid_from"), p["ends"].alias("valid_to")))
    listed = rows.select("domain_name", F.explode(pairs).alias("interval"))
    return listed.select("domain_name", "interval.*").where(F.col("domain_key").isNotNull())


def states(changes: DataFrame, wanted: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """(domain_name, slice, opening, steps) of the slices ``wanted`` (domain_name, slice): the key at their begin and their changes."""
    last = F.element_at("steps", -1)
    listed = slices(changes, seconds).select("domain_name", "slice", "steps", F.struct(last["domain_key"].alias("key")).alias("closing"),
                                             F.lit(False).alias("asked"))
    asked = wanted.select("domain_name", "slice", F.lit(None).cast(listed.schema["steps"].dataType).alias("steps"),
                          F.lit(None).cast(listed.schema["closing"].dataType).alias("closing"), F.lit(True).alias("asked"))
    merged = listed.unionByName(asked).groupBy("domain_name", "slice").agg(
        F.first("steps", ignorenulls=True).alias("steps"), F.first("closing", ignorenulls=True).alias("closing"), F.max("asked").alias("asked"))
    before = Window.partitionBy("domain_name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opened = merged.withColumn("opening", F.last("closing", ignorenulls=True).over(before)["key"])
    return opened.where("asked").select("domain_name", "slice", "opening", "steps")


def with_key_then(events: DataFrame, changes: DataFrame, moment: str = "event_timestamp", name: str = "key_then",
                  seconds: int = SLICE_SECONDS) -> DataFrame:
    """Events with the key that their domain had at their moment; NULL if it was not registered then, or either is missing."""
    placed = events.withColumn("__slice", _slice(F.col(moment), seconds))
    wanted = placed.where(F.col("domain_name").isNotNull() & F.col("__slice").isNotNull()).select(
        "domain_name", F.col("__slice").alias("slice")).distinct()
    known = states(changes, wanted, seconds).where("opening IS NOT NULL OR steps IS NOT NULL").select(
        "domain_name", F.col("slice").alias("__slice"), F.col("opening").alias("__opening"), F.col("steps").alias("__steps"))
    joined = placed.join(broadcast_if_small(known), ["domain_name", "__slice"], "left")
    at = F.col(moment).cast("timestamp")
    past = F.filter("__steps", lambda s: s["changed_at"] <= at)
    key = F.when(F.size(past) > 0, F.element_at(past, -1)["domain_key"]).otherwise(F.col("__opening"))
    return joined.select(*[F.col(c) for c in events.columns], key.alias(name))


def verified_then(events: DataFrame, changes: DataFrame, moment: str = "event_timestamp", seconds: int = SLICE_SECONDS) -> DataFrame:
    """Events whose domain had their key at their moment."""
    found = with_key_then(events, changes, moment, "__key_then", seconds)
    return found.where(F.col("__key_then") == F.col("domain_key")).drop("__key_then")


def unverified_then(events: DataFrame, changes: DataFrame, moment: str = "event_timestamp", seconds: int = SLICE_SECONDS) -> DataFrame:
    """Events that ``verified_then`` leaves out, with ``key_then``, the key that their domain had."""
    found = with_key_then(events, changes, moment, "key_then", seconds)
    return found.where(~F.coalesce(F.col("key_then") == F.col("domain_key"), F.lit(False)))

"""Mix sources to target weights: weighted sampling by exponential keys, whole epochs first.

A source of S words and target T is taken floor(T / S) times as a whole; the rest of the budget goes to the documents
with the smallest Efraimidis-Spirakis keys -ln(u) / quality, in key order; the document that crosses the budget is cut
there. u is derived from the document's id and text, so reruns agree.

The prefix sums need no sorted source in one task. Keys are cut into ``BINS`` bins; sizes are summed by source and bin
(combined before the shuffle) and the bin in which the budget ends is cut again, ``LEVELS`` times. Only the last
bin, about 1 / BINS^LEVELS of a source, is ordered document by document.

Defined cases: null text is empty and has size 0, so it is taken with 0 words; null sources are one source, the last.
Repeated rows are separate documents, in the order of a running number. A quality that is null, not finite or not
positive counts as ``MIN_QUALITY``. No words at all: all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.book import stored

BINS = 1024
LEVELS = 3
MIN_QUALITY = 1e-3


def word_count(text: str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def variety(text: str) -> Column:
    """A quality weight between 0.5 and 1.5: the share of small letters and spaces among the characters."""
    size = F.greatest(F.length(text), F.lit(1))
    kept = F.length(F.translate(F.col(text), "abcdefghijklmnopqrstuvwxyz ", ""))
    return F.coalesce(F.lit(1.5) - kept / size, F.lit(0.5))


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """Add ``target`` to (source, source_size): weights repeat by source order; no target above ``most`` sizes.

    One row per source is read here, in one task. Shares above their limit are found by filling up: in the order of
    limit / weight, a source is at its limit if it would be at the level of all that follow.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)))
    df = df.withColumn("limit", most * F.col("source_size")).withColumn("total", budget * F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"used": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "place": F.row_number().over(order),
                         "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    df = df.withColumn("level", (F.col("total") - F.col("used")) / F.col("rest"))
    df = df.withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)["level"]
    return df.select("source", "source_size",
                     F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


def _key(seed: int) -> Column:
    """A key in (0, 1) whose order is that of -ln(u) / quality."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "mark", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    wait = -F.log(u) / F.col("quality")
    return wait / (1 + wait)


def mix(docs: DataFrame, weights: Sequence[float], budget: float = 1.5, most: float = 2.0, quality: Column | None = None,
        seed: int = 0, id_column: str = "doc_id", text: str = "text", source: str = "source",
        keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, source, target, taken) of each document, and the columns to ``keep``.

    ``budget`` is the share of all words that the mix takes, ``most`` the number of times a document may be taken.
    """
    weight = F.lit(1.0) if quality is None else quality.cast("double")
    usable = (weight > 0) & (weight < float("inf"))
    slim = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
        F.when(usable, F.greatest(weight, F.lit(MIN_QUALITY))).otherwise(MIN_QUALITY).alias("quality"),
        *([F.struct(*keep).alias("kept")] if keep else []))
    slim = slim.withColumn("key", _key(seed)).drop("quality")
    slim = stored(slim.withColumn("row", F.monotonically_increasing_id()), "sizes")

    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(sizes, weights, budget, most), "targets")
    empty = F.col("source_size") == 0
    epochs = F.when(empty, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    plan = plan.withColumn("epochs", epochs.cast("long"))
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    open_bins = plan.select("source", rest.alias("rest"), F.lit(0.0).alias("low"))

    # Level by level: the bin of the key range [low, low + width) in which the rest of the budget ends.
    width, ends = 1.0, []
    for _ in range(LEVELS):
        step = width / BINS
        inside = slim.alias("d").join(open_bins.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source"))).where(
            (F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + width))
        bin_no = F.least(F.floor((F.col("key") - F.col("low")) / step), F.lit(BINS - 1)).cast("int")
        summed = inside.groupBy(F.col("o.source").alias("source"), "low", "rest", bin_no.alias("bin")).agg(
            F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bin")
        summed = summed.withColumn("before", F.sum("words").over(running) - F.col("words"))
        chosen = summed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        open_bins = stored(chosen.select("source", (F.col("rest") - F.col("before")).alias("rest"),
                                         (F.col("low") + F.col("bin") * F.lit(step)).alias("low")), "bins")
        width = step

    last = slim.alias("d").join(open_bins.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source"))).where(
        (F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + width))
    order = Window.partitionBy("o.source").orderBy("key", "doc_id", "mark", "row")
    before = F.sum("size").over(order) - F.col("size")
    cut = last.select("row", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)).alias("part"))

    planned = slim.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.*", "source_size", "target", "epochs")
    planned = planned.alias("d").join(open_bins.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")), "left").select(
        "d.*", "low")
    planned = planned.join(cut, "row", "left")
    chosen_part = F.coalesce("part", F.when(F.col("key") < F.col("low"), F.col("size")), F.lit(0))
    return planned.select(F.col("doc_id").alias(id_column), "size", "source_size", "source", "target",
                          (F.col("epochs") * F.col("size") + chosen_part).alias("taken"), *(["kept.*"] if keep else []))

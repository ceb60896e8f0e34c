"""Bounded training samples from a table of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str = "doc_id", fold: int = 0) -> Column:
    """True for rows whose crc32 of the id as text leaves ``fold`` modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_column: str = "doc_id", text: str = "text",
           max_bytes: int | None = None) -> DataFrame:
    """(label, text): at most ``rows`` / 2 labelled ids of each class, chosen by a hash of the id.

    Rows of the held-out fold are never taken, nor those without text or with more than ``max_bytes`` bytes. An id with
    several labels has the largest; one with several texts gives the one with the least hash, so there are never more rows than ids.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.col(label).cast("int")).alias("label")).where(~held_out("id"))
    wanted = known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(rows // 2).union(
        known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(rows // 2))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    if max_bytes:
        texts = texts.where(F.octet_length("text") <= max_bytes)
    found = texts.join(F.broadcast(wanted), "id")  # at most ``rows`` ids are broadcast
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return found.groupBy("id", "label").agg(one).select("id", "label", "one.text")

"""Near-duplicates by SimHash, with pivot distance tables.

Fingerprints are made in Arrow batches. Different fingerprints are compared inside buckets: the 64 bits are cut into
four blocks, and two fingerprints that differ in at most two bits agree in at least two whole blocks, so the six pairs
of blocks give six bucket keys and lose no pair. (Pivot distances alone cannot partition fingerprints: one pivot keeps
about a third of random pairs, so cells narrow enough would need hundreds of probes each.) Inside a bucket the
table of Hamming distances to the pivots, the reference fingerprints, is computed once; pairs whose largest coordinate
difference exceeds the radius cannot be links (triangle inequality) and are discarded; the rest are verified.

A bucket of more than ``BUCKET`` different fingerprints is not paired up. Its members are listed under themselves and
their 64 one-bit neighbours instead: members of one list are at most two bits apart, and two fingerprints at most two
bits apart have a list in common. Linking each list to its smallest member keeps the components exactly.

Defined cases: null text is empty; a text without words has fingerprint zero, which links like any other; a null
doc_id never becomes a component id unless nothing else is in the component. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import long_simhash, spans
from footfall.llm.book import small_batches, stored
from footfall.llm.components import components
from footfall.llm.long_simhash import bit_majorities, shingles

RADIUS = 2
BUCKET = 256
PIVOTS = 32


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each row of a byte array."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for low, high in spans.chunks(offsets):
        part = spans.LOWER[data[offsets[low]:offsets[high]]]
        text, starts, ends, counts = spans.spaced(part, offsets[low:high + 1] - offsets[low])
        first, last, number = shingles(counts, size)
        out[low:high] = bit_majorities(spans.xxh64(text, starts[first], ends[last]), number)
    return out


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = spans.text_bytes(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(text_fingerprints(data, offsets, size).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(batches, f"doc_id {kind}, fp long")


def pivot_table(fps: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Hamming distance of each fingerprint to each of the fixed pseudo-random pivots."""
    pivots = np.random.default_rng(7).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def close_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs, given consecutive buckets of fingerprints."""
    distances = pivot_table(fps)
    begins = np.cumsum(sizes) - sizes
    found = [np.zeros((2, 0), np.int64)]
    for n in np.unique(sizes[sizes > 1]):
        left, right = np.triu_indices(n, 1)
        block = max(1, 200_000 // len(left))
        heads = begins[sizes == n]
        for k in range(0, len(heads), block):
            a = (heads[k:k + block, None] + left).ravel()
            b = (heads[k:k + block, None] + right).ravel()
            for j in range(0, distances.shape[1], 4):  # a few coordinates at a time: most pairs go at once
                keep = (np.abs(distances[a, j:j + 4] - distances[b, j:j + 4]) <= radius).all(axis=1)
                a, b = a[keep], b[keep]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
            found.append(np.stack([a[near], b[near]]))
    left, right = np.concatenate(found, axis=1)
    return left, right


def _bucket_keys():
    blocks = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*[F.lit(n).cast("long") * (1 << 32) + blocks[i] * (1 << 16) + blocks[j]
                     for n, (i, j) in enumerate(pairs)])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between different fingerprints (column fp) that keep all components of the radius-2 graph."""
    listed = fps.select("fp", F.explode(_bucket_keys()).alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes, "buckets")

    def pairs(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(0)
            values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            a, b = close_pairs(values, column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[a].view(np.int64)), pa.array(values[b].view(np.int64))], names=["a", "b"])

    small = listed.join(sizes.where(F.col("n") <= bucket).select("key"), "key")
    found = small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(pairs, "a long, b long")

    crowded = listed.join(sizes.where(F.col("n") > bucket).select("key"), "key").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long"))
                                   for k in range(64)])
    around = crowded.select("fp", F.explode(flips).alias("spot"))
    least = around.groupBy("spot").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    starred = around.join(least, "spot").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return found.union(starred).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text: str = "text",
                    bucket: int = BUCKET, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; ``size`` is the number of words in a shingle.

    Links are fingerprints at most two bits apart. With a ``similarity``, links are long fingerprints within the radius of
    that Jaccard similarity instead (see ``long_simhash``), and the result is (doc_id, component_id).
    """
    if similarity is not None:
        return long_simhash.near_copies(docs, size, similarity, id_column, text)
    marked = stored(fingerprints(docs, size, id_column, text), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(fps, bucket)).select(F.col("node").alias("fp"), "root")
    placed = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = stored(placed.join(heads, "root").select("fp", "component_id"), "labels")
    return marked.join(labels, "fp").select(
        F.col("doc_id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

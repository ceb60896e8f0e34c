"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is described by the pairs of neighbouring characters in it, characters taken by kind: each small letter and each
common mark alone, capitals, digits, other marks and the parts of other letters by group. Weighted counts (log tf, idf)
are projected on the leading singular vectors of the labelled sample. The labelled vectors are broadcast (their number
is a parameter), and every document meets all of them in blocks of exact cosine products; the nearest ``k`` vote with
the part of their similarity that is above the weakest neighbour's.

Defined cases: null and empty texts, and texts without a pair, have no neighbours and score the sample's share of label
1; without any labelled row that share is 0.5. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import labelled, spans
from footfall.llm.book import small_batches

LABELLED = 4000  # rows of the sample, half of each class
RANK = 48
NEAREST = 15
BLOCK = 256

KINDS = 64
_MARKS = ".,;:!?'\"-|*$#%&@()/<>=_+[]{}"
KIND = np.full(256, 61, np.uint16)
for _n, _c in enumerate("abcdefghijklmnopqrstuvwxyz" + _MARKS):
    KIND[ord(_c)] = _n
KIND[ord("A"):ord("Z") + 1] = 56
KIND[ord("0"):ord("9") + 1] = 57
KIND[[0x20, 0x09]] = 58
KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = 59
KIND[0x80:0xC0] = 60
KIND[0xC0:] = 62
PAIRS = KINDS * KINDS
FEATURES = PAIRS + 2


def repetition(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of words that equal the one before, and of word triples that occur again, of each text."""
    plain = spans.LOWER[data]
    starts, ends, counts = spans.words(plain, offsets)
    words, owner = spans.xxh64(plain, starts, ends), spans.owners(counts)
    out = np.zeros((len(counts), 2), np.float32)
    same = np.zeros(len(words), np.int64)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out[:, 0] = spans.sums(same, counts) / np.maximum(counts - 1, 1)
    if len(words) > 2:
        with np.errstate(over="ignore"):
            triple = (words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:]
            triple = triple * np.uint64(0x9E3779B97F4A7C15) ^ owner[2:].astype(np.uint64)
        whole = owner[2:] == owner[:-2]
        _, back, times = np.unique(triple[whole], return_inverse=True, return_counts=True)
        again = np.bincount(owner[2:][whole], times[back] > 1, len(counts))
        out[:, 1] = again / np.maximum(counts - 2, 1)
    return out


def pair_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + count) of each pair of kinds and the two shares, one row per text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES), np.float32)
    kinds = KIND[data]
    codes = kinds[:-1] * KINDS + kinds[1:]
    for r in range(rows):
        if offsets[r + 1] - offsets[r] > 1:
            out[r, :PAIRS] = np.bincount(codes[offsets[r]:offsets[r + 1] - 1], minlength=PAIRS)
    np.log1p(out, out=out)
    out[:, PAIRS:] = repetition(data, offsets)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Space:
    """Latent-semantic vectors of a labelled sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float32)
        self.share = float(labels.mean()) if len(labels) else 0.5
        seen = (counts[:, :PAIRS] > 0).sum(axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
        weighted = self._weighted(counts)
        rank = min(rank, *weighted.shape) if len(counts) else 0
        probe = np.random.default_rng(1).standard_normal((FEATURES, rank + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            probe = weighted.T @ np.linalg.qr(weighted @ probe)[0] if rank else probe
        basis = np.linalg.qr(probe)[0] if rank else probe[:, :0]
        if rank:
            turn = np.linalg.svd(weighted @ basis, full_matrices=False)[2]
            basis = basis @ turn[:rank].T
        self.basis = np.ascontiguousarray(basis, np.float32)
        self.vectors = _unit(weighted @ self.basis)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        """The pairs' direction and the two shares, as one direction."""
        return _unit(np.concatenate([_unit(counts[:, :PAIRS] * self.idf), counts[:, PAIRS:]], axis=1))

    def scores(self, counts: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
        out = np.full(len(counts), self.share)
        some = np.flatnonzero(counts.any(axis=1)) if len(self.labels) else []
        if not len(some):
            return out
        alike = _unit(self._weighted(counts[some]) @ self.basis) @ self.vectors.T
        k = min(nearest, len(self.labels) - 1)
        if not k:
            out[some] = self.share
            return out
        top = np.argpartition(-alike, k, axis=1)[:, :k + 1]
        near = np.take_along_axis(alike, top, axis=1)
        weight = near - near.min(axis=1, keepdims=True) + 1e-9
        out[some] = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LABELLED, id_column: str = "doc_id",
        text: str = "text") -> Space:
    """The space of a bounded sample; its texts are counted on the executors."""

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = spans.text_bytes(part.column(2))
            counts = [pair_counts(data[offsets[r]:offsets[r + 1]], offsets[r:r + 2] - offsets[r])[0].tobytes()
                      for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.binary())],
                                             names=["id", "label", "counts"])

    taken = labelled.sample(docs, labels, label, rows, id_column, text)
    kind = taken.schema["id"].dataType.simpleString()
    got = taken.mapInArrow(batches, f"id {kind}, label int, counts binary").toArrow().sort_by([("id", "ascending")])
    counts = np.frombuffer(b"".join(got["counts"].to_pylist()), np.float32).reshape(-1, FEATURES)
    return Space(counts, got["label"].to_numpy().astype(np.float32))


def score(docs: DataFrame, space: Space, threshold: float = 0.3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(space)

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = spans.text_bytes(part.column(1))
            scores = np.zeros(part.num_rows)
            for low in range(0, part.num_rows, BLOCK):
                high = min(low + BLOCK, part.num_rows)
                some = pair_counts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                scores[low:high] = sent.value.scores(some)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = docs.select(F.col(id_column), F.col(text)).mapInArrow(batches, f"doc_id {kind}, score double, predicted int")
    return scored.withColumnRenamed("doc_id", id_column)

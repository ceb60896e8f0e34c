"""Hard negatives by a secondary-sort shuffle.

Every anchor is scored against all rows in blocks: rows are dealt to groups of ``ROWS``, anchors to blocks of ``ANCHORS``, and each
group meets each block once in a task that holds nothing else. Two passes keep what is shuffled small:

1. Each group sends its best ``positives`` rows of the anchor's label. Sorted by (anchor, descending score, id), a streaming
   iterator keeps the first of them.
2. Knowing the scores of an anchor's positives, each group sends for each positive's window the best ``negatives`` rows of another label
   inside it, which holds all that the group can add to the result. Positives and negatives are shuffled by anchor and sorted within
   partitions by (anchor, descending score, kind, id). The iterator reads that stream once: a positive opens its window, a
   negative is given to the open windows that it fits, a window closes when it is full or the scores have fallen below it. Its
   state is the open windows, never an anchor's rows. (``repartition`` and ``sortWithinPartitions`` are the data frame's form of
   ``repartitionAndSortWithinPartitions``: the sort happens in the JVM and spills.)

A window of a positive with score p holds negatives with low * p <= 100 * score <= high * p. As high <= 100, its negatives never come
before the positive in the stream, for p >= 0; for p < 0 the window is empty, as low < high.

Sums are exact: a block is computed in doubles if no sum can leave their whole-number range, else in 64-bit integers, else in
Python's whole numbers; scores beyond 64 bits count as the nearest 64-bit number.

Defined cases: rows whose id, label or vector is null, or whose vector holds null or non-finite components, take no part. Vectors of
different lengths compare as if zeros followed the shorter one; an empty vector scores 0. A row is never a partner of an anchor with its
own id; repeated rows are separate partners; anchors that repeat an id are one anchor, the one with the smallest label and vector.
An anchor without positives, or whose windows are empty, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.book import stored

ROWS = 8192  # rows of a group
ANCHORS = 4096  # anchors of a block
STRIP = 256  # anchors scored at once
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
_SAFE = 1 << 52  # sums below this are exact in doubles, and so are all whole numbers


def whole_vectors(rows: DataFrame, id_column: str, vector: str, label: str | Column, scale: int) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each usable vector, as whole doubles."""
    whole = lambda y: F.when(F.abs(y) < float(_SAFE), F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger ones have no fraction
    x = F.transform(F.col(vector), lambda c: whole(c.cast("double") * scale))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector)).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & fine).select("vec_id", "label", x.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows, shorter ones followed by zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(max(lengths, default=0))))
    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), inner] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both, as 64-bit integers."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, width)
    if most < _SAFE:
        return (left @ right.T).astype(np.int64)
    if most < _SAFE << 9 and max(np.abs(left).max(), np.abs(right).max()) < _SAFE:
        return left.astype(np.int64) @ right.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in side], object).reshape(len(side), width) for side in (left, right)]
    sums = whole[0] @ whole[1].T
    return np.array([[min(max(int(x), LOWEST), HIGHEST) for x in row] for row in sums], np.int64).reshape(sums.shape)


def combined(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _sides(left: pa.Table, right: pa.Table):
    """Ids, labels and vectors of the anchors and, in order of ids, of the rows of a group."""
    right = right.sort_by("vec_id")
    return [(combined(t.column("vec_id")).to_numpy(), combined(t.column("label")).to_numpy(), matrix(combined(t.column("v"))))
            for t in (left, right)]


def best_positives(ids: np.ndarray, labels: np.ndarray, row_ids: np.ndarray, row_labels: np.ndarray, scores: np.ndarray,
                   k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row): positions of each anchor's best k rows of its label; rows are in order of ids."""
    found = [np.zeros((2, 0), np.int64)]
    for label in np.unique(labels):
        rows, anchors = np.flatnonzero(row_labels == label), np.flatnonzero(labels == label)
        if not len(rows):
            continue
        some = scores[np.ix_(anchors, rows)]
        order = np.argsort(~some, axis=1, kind="stable")[:, :k + 1]  # ~x falls as x rises, without overflow
        own = row_ids[rows[order]] == ids[anchors, None]
        if own.sum(axis=1).max(initial=0) > 1 or k >= len(rows):  # repeated rows of the anchor's id
            for j, anchor in enumerate(anchors):
                full = np.argsort(~some[j], kind="stable")
                full = full[row_ids[rows[full]] != ids[anchor]][:k]
                found.append(np.stack([np.full(len(full), anchor), rows[full]]))
            continue
        keep = ~own & (np.cumsum(~own, axis=1) <= k)
        j, at = np.nonzero(keep)
        found.append(np.stack([anchors[j], rows[order[j, at]]]))
    a, r = np.concatenate(found, axis=1)
    return a, r


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score of a positive's window."""
    return -((-low * score) // 100), (high * score) // 100


def best_in_windows(ids: np.ndarray, labels: np.ndarray, windows: list[list[int]], row_ids: np.ndarray, row_labels: np.ndarray,
                    scores: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row): positions of the best k rows of another label in each window, each once; rows are in order of ids."""
    order = np.argsort(~scores, axis=1, kind="stable")
    found = [np.zeros((2, 0), np.int64)]
    for j, positives in enumerate(windows):
        rows = order[j][(row_labels[order[j]] != labels[j]) & (row_ids[order[j]] != ids[j])]
        falling = ~scores[j, rows]
        taken: set[int] = set()
        for p in positives:
            least, most = bounds(int(p), low, high)
            if least > most or least > HIGHEST or most < LOWEST:
                continue
            begin, end = np.searchsorted(falling, ~min(most, HIGHEST), "left"), np.searchsorted(falling, ~max(least, LOWEST), "right")
            taken.update(range(begin, min(end, begin + k)))
        found.append(np.stack([np.full(len(taken), j), rows[np.array(sorted(taken), np.int64)]]))
    a, r = np.concatenate(found, axis=1)
    return a, r


def meet(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, task, schema: str) -> DataFrame:
    """Apply a task to each pair of a group of rows and a block of anchors; both are bounded."""
    left = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(task, schema)


def _strips(left: pa.Table, right: pa.Table):
    (ids, labels, vectors), (row_ids, row_labels, row_vectors) = _sides(left, right)
    for at in range(0, len(ids), STRIP):
        some = slice(at, at + STRIP)
        yield some, ids[some], labels[some], row_ids, row_labels, inner_products(vectors[some], row_vectors)


def _table(columns: list[tuple[str, list[np.ndarray]]]) -> pa.Table:
    return pa.table({name: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()) for name, parts in columns})


def dealt(df: DataFrame, name: str, size: int, label: str) -> tuple[DataFrame, int]:
    """Rows dealt to numbered groups of about a size, whatever their values."""
    df = stored(df, label)
    groups = max(1, -(-df.count() // size))
    return df.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")), groups


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         rows_at_once: int = ROWS, anchors_at_once: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows of (vec_id, label, v).

    ``low`` and ``high`` are per cent of the positive's score, high at most 100.
    """
    if not 0 <= low < high <= 100:
        raise ValueError("0 <= low < high <= 100 is needed")
    chosen = vectors.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.*")
    rows, groups = dealt(vectors, "g", rows_at_once, "rows")
    anchors, blocks = dealt(chosen, "b", anchors_at_once, "anchors")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for _, ids, labels, row_ids, row_labels, scores in _strips(left, right):
            a, r = best_positives(ids, labels, row_ids, row_labels, scores, positives)
            out.append((ids[a], scores[a, r], row_ids[r]))
        return _table([(name, [x[n] for x in out]) for n, name in enumerate(("anchor", "score", "id"))])

    def first(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        for part in parts:
            keep = []
            for anchor in part.column(0).to_pylist():
                taken = taken + 1 if anchor == last else 1
                last = anchor
                keep.append(taken <= positives)
            yield part.filter(pa.array(keep, pa.bool_()))

    triple = "anchor long, score long, id long"
    pairs = meet(rows, anchors, groups, blocks, near, triple)
    ranked = pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "id").mapInArrow(first, triple)
    partners = stored(ranked, "positives")
    # At most ``positives`` rows for each anchor.
    windows = partners.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_set("score").alias("windows"))
    opened = anchors.join(windows, "vec_id")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        sought = combined(left.column("windows")).to_pylist()
        for some, ids, labels, row_ids, row_labels, scores in _strips(left, right):
            a, r = best_in_windows(ids, labels, sought[some], row_ids, row_labels, scores, negatives, low, high)
            out.append((ids[a], scores[a, r], row_ids[r]))
        return _table([(name, [x[n] for x in out]) for n, name in enumerate(("anchor", "score", "id"))])

    found = meet(rows, opened, groups, blocks, hard, triple)
    stream = partners.withColumn("negative", F.lit(False)).unionByName(found.withColumn("negative", F.lit(True)))

    def emit(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_windows = None, []
        for part in parts:
            out = []
            for anchor, score, row, negative in zip(*(c.to_pylist() for c in part.columns)):
                if anchor != last:
                    last, open_windows = anchor, []
                if not negative:
                    least, most = bounds(score, low, high)
                    if least <= most:
                        open_windows.append([row, score, least, most, 0])
                    continue
                open_windows = [w for w in open_windows if w[4] < negatives and w[2] <= score]
                for w in open_windows:
                    if score <= w[3]:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], row, w[1], score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(zip(*out) if out else [[]] * 6)], names=names)

    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    names = [c.split()[0] for c in kind.split(", ")]
    return stream.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "negative", "id").select(
        "anchor", "score", "id", "negative").mapInArrow(emit, kind)

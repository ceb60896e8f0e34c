"""Exact top-k by inner product with MaxScore over shards of integer vectors.

The terms of a query are the dimensions where it is not zero; a dimension's posting list in a shard is its column of
values. Contributions may be negative, so each is taken relative to the least one of its list in the shard: then all
are at least 0 and at most the list's bound. For each query the terms are ordered by bound; the non-essential ones
are the weakest whose bounds together cannot lift a document over the query's current k-th score. Essential lists are
traversed for all documents of a shard; the others are probed, strongest first, only for documents that can still
compete. Each group's best k are merged by rank.

Rows are dealt to groups of ``ROWS`` and queries to blocks of ``BLOCK``; each group meets each block once, in a task that holds nothing
else. Nothing is collected or broadcast, and the plan is the same for any number of queries.

Sums are exact: vectors are computed in doubles if no sum can leave their whole-number range, else in 64-bit integers, else in
Python's whole numbers. Vectors with large components are searched apart, so they don't slow the others of their shard.
Scores beyond 64 bits count as the nearest 64-bit number.

Defined cases: rows whose id or vector is null, or whose vector holds null or non-finite components (also once scaled), take no
part. Vectors of different lengths compare as if zeros followed the shorter one; an empty vector scores 0. A row is never a
candidate of a query with its own id; repeated rows are separate candidates; queries that repeat an id are one query, the one
with the smallest vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.hard_negatives import HIGHEST, LOWEST, combined, dealt, matrix, meet

BLOCK = 2048  # queries of a block
ROWS = 16384  # vectors of a group
SHARD = 4096  # vectors searched at once
_SAFE = 1 << 52  # sums below this are exact in doubles, and so are all whole numbers


def whole_vectors(rows: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each usable vector, as whole doubles."""
    scaled = F.transform(F.col(vector), lambda c: c.cast("double") * scale)
    fine = F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < float(_SAFE), F.floor(y).cast("double")).otherwise(y))  # larger ones have no fraction
    return rows.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & fine).select(
        F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, without overflow


def _fit(scores: np.ndarray) -> np.ndarray:
    """Exact sums as 64-bit integers."""
    if scores.dtype == object:
        return np.array([min(max(x, LOWEST), HIGHEST) for x in scores], np.int64)
    return scores.astype(np.int64)


def _numbers(values: np.ndarray, kind: type) -> np.ndarray:
    """Whole doubles as numbers of a kind."""
    if kind is object:
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return values.astype(kind)


def _kind(most: float) -> type:
    """Numbers that hold sums of this size, and differences of two, exactly."""
    return np.float64 if most < _SAFE else np.int64 if most < _SAFE << 8 else object


def search_shard(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
                 floor: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, ids, scores) of the best k of one shard for each query.

    ``floor`` holds k-th scores already reached elsewhere; documents strictly below them may be left out.
    """
    width = min(queries.shape[1], vectors.shape[1])
    if not len(vectors):
        return
    vectors = vectors[:, :width]
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    reach = float(np.abs(vectors).max(initial=0)) * max(1, width)
    lists: dict[type, np.ndarray] = {}  # the posting lists, in each kind of number that is needed
    for i, query in enumerate(queries[:, :width]):
        kind = _kind(float(np.abs(query).max(initial=0)) * reach)
        if kind not in lists:
            lists[kind] = np.ascontiguousarray(_numbers(vectors.T, kind))
        yield i, *_search(_numbers(query, kind), _numbers(low, kind), _numbers(high, kind), lists[kind], ids,
                          ids != query_ids[i], k, None if floor is None else floor[i])


def _search(weights: np.ndarray, low: np.ndarray, high: np.ndarray, lists: np.ndarray, ids: np.ndarray, allowed: np.ndarray,
            k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best k for one query."""
    width = len(weights)
    ends = np.stack([weights * low, weights * high])
    least, bound = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
    order = np.argsort(-bound, kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from here on can add
    threshold = floor
    if threshold is None:  # start from the k-th of the documents that look best on the strongest terms
        first = order[:8]
        look = np.where(allowed, (weights[first] @ lists[first]).astype(np.float64), -np.inf)
        seeds = np.argpartition(-look, min(k, len(ids)) - 1)[:k]
        exact = np.sort((weights @ lists[:, seeds])[allowed[seeds]])
        threshold = exact[0] if len(exact) == k else None
    if threshold is not None:  # scores beyond 64 bits are ties
        threshold = min(threshold, HIGHEST) if threshold > LOWEST else None
    if threshold is None:
        alive = np.flatnonzero(allowed)
        score = weights @ lists[:, alive]
    else:
        base = least.sum()
        essential = int(np.searchsorted(-(base + rest), -threshold, "right"))  # the others cannot reach it alone
        essential = min(width, max(essential, 1))
        score = base + weights[order[:essential]] @ lists[order[:essential]] - least[order[:essential]].sum()
        alive = np.flatnonzero((score + rest[essential] >= threshold) & allowed)
        score, done = score[alive], essential
        while done < width and len(alive):
            terms = order[done:done + 4]
            score = score + weights[terms] @ lists[np.ix_(terms, alive)] - least[terms].sum()
            done = min(width, done + 4)
            keep = score + rest[done] >= threshold
            alive, score = alive[keep], score[keep]
    score = _fit(score)
    chosen = _best(score, ids[alive], k)
    return ids[alive][chosen], score[chosen]


def search_group(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
                 shard: int = SHARD) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the best k of a group of rows for each query, shard by shard; large vectors come last."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)
    floor = np.full(len(query_ids), None, object)
    most = np.abs(vectors).max(axis=1, initial=0)
    width = max(1, min(queries.shape[1], vectors.shape[1]))
    large = most > np.sqrt(_SAFE / width) / 2
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        for at in range(0, len(rows), shard):
            some = rows[at:at + shard]
            for i, got, scores in search_shard(queries, query_ids, vectors[some], ids[some], k, floor):
                got, scores = np.append(best[i][0], got), np.append(best[i][1], scores)
                top = _best(scores, got, k)
                best[i] = got[top], scores[top]
                if len(top) == k:
                    floor[i] = int(scores[top[-1]])
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, rows_at_once: int = ROWS,
          shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, v) that ``is_query`` selects, against all rows."""
    rows, groups = dealt(vectors, "g", rows_at_once, "rows")
    queries, blocks = dealt(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "b", block, "queries")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, ids = (combined(t.column("vec_id")).to_numpy() for t in (left, right))
        best = search_group(matrix(combined(left.column("v"))), query_ids, matrix(combined(right.column("v"))), ids, k, shard)
        found = [np.repeat(query_ids, [len(got) for got, _ in best])]
        found += [np.concatenate([np.zeros(0, np.int64), *(b[n] for b in best)]) for n in (0, 1)]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), found)})

    found = meet(rows, queries, groups, blocks, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Near-duplicates by b-bit MinHash: links between documents whose sets of word shingles have a Jaccard similarity of a bound or more.

Each text's distinct shingles give ``BANDS`` x ``WIDTH`` minima. The whole minima of a band make a bucket key; of every minimum two
bits are retained and packed, 32 to a number. Texts that share a bucket are candidates. The share of equal positions m of two
packed signatures, counted by bit operations, estimates their similarity, corrected for chance agreement: (m - 1/4) / (1 - 1/4). Candidates
whose estimate is ``DEVIATIONS`` standard deviations below the bound go; the rest are confirmed on their full sets. A pair at 0.85
shares no bucket with a probability of 3e-7, and is lost by its estimate with one of 3e-7; pairs above the bound with smaller ones.

Texts with equal sets are one text. Links are found so that no group's pairs are all written down:

1. In ``ROUNDS`` rounds each bucket has a pivot, its member with the least rank (ranks are the same in all buckets, so a large group
   has few pivots), found by a combinable minimum. Members are paired with the pivots of their buckets, confirmed, and joined.
2. Buckets whose members are not all joined yet are compared whole, those of more than ``BLOCK`` shingles block by block: the full sets
   of a block, or of two, meet in one task, which confirms candidates with different labels there and gives only links that join labels.
   So every candidate pair is a link, not one, or inside a component already.

``near_duplicates`` gives components; a link inside a component that the rounds have joined needs no row of its own.

Defined cases: A-Z are lower-cased; null text is empty; a text without words has an empty set and is linked with nothing; one with fewer
words than a shingle has its whole sequence as the only shingle. Repeated rows each get a row. A null id counts as the largest and never
becomes a component id unless nothing else is in the component; ``kept`` is null-safe. Rows of one id with different texts are documents
of their own. 64-bit hashes stand for shingles; equal sets are recognised by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm import spans
from footfall.llm.book import small_batches, stored
from footfall.llm.components import components

BANDS, WIDTH = 32, 6
KEEP = 2  # bits retained of each minimum
PACKED = BANDS * WIDTH * KEEP // 64
DEVIATIONS = 5
ROUNDS = 1
BLOCK = 1 << 18  # shingles compared at once with each other or as many others
STRIP = 1 << 15  # hashes that are permuted at once
_EVEN = 0x5555555555555555
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in order, and their number."""
    found, counted = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in spans.chunks(offsets):
        lower = spans.LOWER[data[offsets[low]:offsets[high]]]
        text, starts, ends, words = spans.spaced(lower, offsets[low:high + 1] - offsets[low])
        number = np.where(words < size, np.minimum(words, 1), words - size + 1)
        row = spans.owners(number)
        first = np.arange(len(row)) + (np.cumsum(words) - words - np.cumsum(number) + number)[row]
        hashes = spans.xxh64(text, starts[first], ends[first + np.minimum(words, size)[row] - 1])
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])][:len(hashes)]
        found.append(hashes[fresh])
        counted.append(np.bincount(row[fresh], minlength=high - low))
    return np.concatenate(found), np.concatenate(counted)


def minima(hashes: np.ndarray, number: np.ndarray, functions: int = BANDS * WIDTH) -> np.ndarray:
    """(rows, functions): the least value of each row's hashes under each function; all ones for an empty row."""
    out = np.full((len(number), functions), np.iinfo(np.uint64).max, np.uint64)
    factors = np.random.default_rng(17).integers(1 << 62, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ends = np.cumsum(number)
    for at in range(0, len(hashes), STRIP):
        strip = hashes[at:at + STRIP]
        low, high = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + len(strip), "left"))
        rows = np.arange(low, high + 1)
        rows = rows[number[rows] > 0]
        begins = np.maximum(ends[rows] - number[rows] - at, 0)
        least = np.empty((len(rows), functions), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(functions):
                least[:, k] = np.minimum.reduceat(strip * factors[k], begins)
        out[rows] = np.minimum(out[rows], least)  # a row may go on from the strip before
    return out


def signatures(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (rows, BANDS) and packed retained bits (rows, PACKED), both as signed numbers."""
    bands = least.reshape(len(least), BANDS, WIDTH)
    with np.errstate(over="ignore"):
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (len(least), 1))
        for k in range(WIDTH):
            keys = (keys ^ bands[:, :, k]) * _STEP
            keys ^= keys >> np.uint64(31)
        # The low bits of a product hang on the low bits of the hash alone, so the minima are mixed before bits are taken.
        mixed = (least ^ (least >> np.uint64(33))) * _STEP
        two = (mixed >> np.uint64(64 - KEEP)).reshape(len(least), PACKED, -1)
        packed = (two << (np.arange(two.shape[2], dtype=np.uint64) * np.uint64(KEEP))).sum(axis=2, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def least_matches(similarity: float, functions: int = BANDS * WIDTH) -> int:
    """Equal positions that a pair of the similarity has but for ``DEVIATIONS`` standard deviations."""
    share = similarity + (1 - similarity) / 2**KEEP
    return math.floor(functions * share - DEVIATIONS * math.sqrt(functions * share * (1 - share)))


def matches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal positions of packed signatures, along the last axis."""
    apart = (left ^ right).view(np.uint64)
    apart = (apart | (apart >> np.uint64(1))) & np.uint64(_EVEN)
    return BANDS * WIDTH - np.bitwise_count(apart).sum(axis=-1, dtype=np.int64)


def matches_of(left: str, right: str) -> Column:
    """The same for two array columns."""
    apart = f"({left}[k] ^ {right}[k])"
    return F.expr(f"{BANDS * WIDTH} - aggregate(sequence(0, {PACKED - 1}), 0, (n, k) -> n + cast(bit_count("
                  f"({apart} | shiftrightunsigned({apart}, 1)) & {_EVEN}L) as int))")


def _sizes_fit(percent: int) -> Column:
    """The smaller of two sets with a similarity is at least so large."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(fid, hashes) of texts (fid, body): the distinct shingle hashes in order."""

    def as_sets(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes, number = shingle_sets(*spans.text_bytes(part.column(1)), size)
            ends = np.cumsum(number)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([hashes[e - n:e].astype("<u8").tobytes() for e, n in zip(ends, number)], pa.binary())],
                names=["fid", "hashes"])

    return stored(texts.mapInArrow(as_sets, "fid long, hashes binary"), "full-sets")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of text numbers whose full sets (fid, hashes) have the similarity."""

    def check(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            (left, begin), (right, start) = (spans.text_bytes(part.column(k)) for k in (2, 3))
            keep = np.zeros(part.num_rows, bool)
            for r in range(part.num_rows):
                x, y = left[begin[r]:begin[r + 1]].view("<u8"), right[start[r]:start[r + 1]].view("<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[r] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    one, two = (full.select(F.col("fid").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long"), "confirmed")


def pivot_pairs(members: DataFrame, sets: DataFrame, percent: int, seed: int) -> DataFrame:
    """(a, b): each member with the pivots of its buckets, if their signatures and sizes allow the similarity.

    ``members`` is (key, fid, label): only members whose label is not the pivot's are paired.
    """
    ranked = F.struct(F.xxhash64("fid", F.lit(seed)), "fid", "label")
    pivots = stored(members.groupBy("key").agg(F.min(ranked).alias("first")).select(
        "key", F.col("first.fid").alias("pivot"), F.col("first.label").alias("pivot_label")), "pivots")
    met = members.join(pivots, "key").where("label <> pivot_label").select(
        F.least("fid", "pivot").alias("a"), F.greatest("fid", "pivot").alias("b")).distinct()
    one, two = (sets.select(F.col("fid").alias(c), F.col("n").alias(f"n_{c}"), F.col("packed").alias(f"packed_{c}")) for c in "ab")
    return met.join(one, "a").join(two, "b").where(
        _sizes_fit(percent) & (matches_of("packed_a", "packed_b") >= least_matches(percent / 100))).select("a", "b")


def links_between(fid: np.ndarray, label: np.ndarray, n: np.ndarray, packed: np.ndarray, hashes: np.ndarray, side: np.ndarray,
                  percent: int) -> np.ndarray:
    """(2, links): links that join the labels of one block, or of two (``side`` 0 and 1), as all its links would.

    ``hashes`` holds the full sets of all members, one after the other.
    """
    least, label = least_matches(percent / 100), label.copy()
    _, token = np.unique(hashes, return_inverse=True)
    begin = np.cumsum(n) - n
    mark = np.zeros(len(token), bool)
    values, counts = np.unique(label, return_counts=True)
    found = [np.zeros((2, 0), np.int64)]
    sides = [np.flatnonzero(side == k) for k in (0, 1)] if side.any() and not side.all() else [np.arange(len(fid))] * 2
    for x in np.flatnonzero(label != values[counts.argmax()]):  # one of two members with different labels is here
        y = sides[0] if side[x] and sides[1] is not sides[0] else sides[1]
        y = y[(label[y] != label[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        y = y[matches(packed[x], packed[y]) >= least]
        if not len(y):
            continue
        own = token[begin[x]:begin[x] + n[x]]
        mark[own] = True
        ends = np.cumsum(n[y])
        place = np.arange(ends[-1]) + np.repeat(begin[y] - ends + n[y], n[y])
        both = np.add.reduceat(mark[token[place]].astype(np.int64), ends - n[y])
        mark[own] = False
        y = y[100 * both >= percent * (n[x] + n[y] - both)]
        _, first = np.unique(label[y], return_index=True)
        found.append(np.stack([np.minimum(fid[x], fid[y[first]]), np.maximum(fid[x], fid[y[first]])]))
        label[np.isin(label, label[y])] = label[x]
    return np.concatenate(found, axis=1)


def open_links(members: DataFrame, sets: DataFrame, full: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): links that join what the links inside each bucket join; pairs are compared on full sets where they meet."""

    def inside(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [np.zeros((2, 0), np.int64)]
            for group in part.column(0):
                flat = group.values
                fid, label, n, side = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("fid", "label", "n", "side"))
                packed = flat.field("packed").flatten().to_numpy(zero_copy_only=False).reshape(len(fid), PACKED)
                hashes = spans.text_bytes(flat.field("hashes"))[0].view("<u8")
                found.append(links_between(fid, label, n, packed, hashes, side, percent))
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sized = stored(members.join(sets.select("fid", "n"), "fid"), "sized")
    blocks = F.least(F.ceil(F.sum("n") / block), F.count("*")).cast("int")
    totals = stored(sized.groupBy("key").agg(blocks.alias("blocks")), "open-buckets")
    dealt = sized.join(totals, "key").withColumn("block", F.pmod(F.xxhash64("fid"), F.col("blocks")).cast("int"))
    # A bucket's blocks meet two by two: block x goes to the pairs of x and each other block, as the first or the second side.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = dealt.select("key", "fid", "label", "block", other).select(
        "key", "fid", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"))
    listed = spread.join(sets.select("fid", "n", "packed"), "fid").join(full, "fid")
    groups = listed.groupBy("key", "i", "j").agg(F.collect_list(F.struct("fid", "label", "n", "packed", "side", "hashes")).alias("group"))
    return stored(groups.select("group").mapInArrow(inside, "a long, b long").distinct(), "open-links")


def _labels(fids: DataFrame, edges: DataFrame) -> DataFrame:
    """(fid, label): the smallest number that each text can reach."""
    found = components(edges).select(F.col("node").alias("fid"), "root")
    return stored(fids.select("fid").join(found, "fid", "left").select("fid", F.coalesce("root", "fid").alias("label")), "labels")


def _still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, fid, label) of the buckets whose members have several labels."""
    placed = stored(members.select("key", "fid").join(labels, "fid"), "placed")
    several = stored(placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key"), "several")
    return placed.join(several, "key")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, id_column: str = "doc_id", text: str = "text",
                    block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; links have a similarity of ``percent`` / 100 or more."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes, number = shingle_sets(*spans.text_bytes(part.column(2)), size)
            keys, packed = signatures(minima(hashes, number))
            ends = np.cumsum(number)
            digests = [hashlib.blake2b(hashes[e - n:e].tobytes(), digest_size=16).digest() for e, n in zip(ends, number)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, packed)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(digests, pa.binary()), pa.array(number), *lists],
                                             names=["id", "mark", "digest", "n", "keys", "packed"])

    body = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("mark"), body.alias("body"))
    rows = stored(texts.mapInArrow(batches, f"id {kind}, mark long, digest binary, n long, keys array<long>, packed array<long>"), "signatures")
    # A null id counts as the largest: minima pass over nulls.
    source = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("source")
    sets = rows.groupBy("digest", "n").agg(F.min("id").alias("first_id"), source, F.first("keys").alias("keys"), F.first("packed").alias("packed"))
    sets = stored(sets.withColumn("fid", F.monotonically_increasing_id()), "sets")

    # Members of buckets with two texts or more; each key is counted by itself, before any member is looked at.
    listed = sets.where("n > 0").select("fid", F.explode("keys").alias("key"))
    shared = stored(listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "shared")
    members = stored(listed.join(shared, "key"), "members")
    # Whatever can be in a pair has its whole set made once, from one row with that text.
    wanted = sets.join(members.select("fid").distinct(), "fid").select("fid", "source.id", "source.mark")
    same = texts["id"].eqNullSafe(wanted["id"]) & (texts["mark"] == wanted["mark"])
    full = full_sets(texts.join(wanted, same).groupBy("fid").agg(F.first("body").alias("body")), size)

    fids = sets.select("fid")
    unjoined, edges = members.withColumn("label", F.col("fid")), docs.sparkSession.createDataFrame([], "a long, b long")
    for k in range(rounds + 1):
        if k < rounds:
            found = confirmed(stored(pivot_pairs(unjoined, sets, percent, k), "pairs"), full, percent)
        else:
            found = open_links(unjoined, sets, full, percent, block)
        edges = edges.union(found)
        labels = _labels(fids, edges)
        if k == rounds or (unjoined := _still_open(members, labels)).isEmpty():
            break

    placed = labels.join(sets.select("fid", "digest", "n", "first_id"), "fid")
    heads = placed.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = stored(placed.join(heads, "label").select("digest", "n", F.when(F.col("n") > 0, F.col("component_id")).alias("component_id")), "named")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select("id", "digest", "n").join(named, ["digest", "n"]).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("id")).alias("kept"))

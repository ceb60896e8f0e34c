"""The SimHash operator's similarity mode: near copies whose sets of word shingles have a Jaccard similarity of at least a bound.

Texts with equal sets are one text. Of each other text the distinct shingles (a repeated line counts once) make a fingerprint of
``BITS`` bits; the Hamming distance of two estimates the angle between the sets, so a similarity s becomes a radius: cos(angle) =
2s / (1 + s) for sets of one size, more for others. ``MARGIN`` more bits keep candidates that the estimate puts too far. Every link
is verified: the exact Jaccard similarity of the two sets of shingle hashes decides.

Candidates share a bucket and lie inside the radius. A text is in ``KEYS`` buckets, each named by ``TAKEN`` minima of its shingles' hashes under
as many functions: two texts of a similarity s share one with a probability of 1 - (1 - s^4)^16, 0.9998 at 0.8, and unrelated ones
hardly ever, however many texts there are. Inside the radius lie 0.97 of the pairs at 0.8 itself. (Bits sampled from the fingerprints
would need hundreds of tables for that.) Candidates are verified in two rounds:

1. In a bucket, members in turn become pivots: the distances of all members to the pivot are computed once; those inside the
   radius are linked to it, and a member outside is compared with a linked one only if their distances to the pivot differ by no
   more than the radius (the triangle inequality excludes the rest). The ``NEAREST`` links of each text are verified. This
   joins most of a large group with a number of links that grows with its size, not with its square.
2. Buckets whose members are not all joined yet are compared whole: the shingle sets of a bucket meet in one task. A table of the
   members' distances to ``PIVOTS`` reference fingerprints is computed once; pairs of different components whose largest difference of
   coordinates is beyond the radius go, then those whose own distance is, and the exact similarity decides. Only links that join
   components are written, so no candidate pair is left out and none is listed.

Buckets of more than ``BUCKET`` members are cut into blocks; the first round stays inside a block. Buckets of more than ``BLOCK`` shingles
are cut in the second: the members of the bucket's largest component into some blocks, the others into further ones, and each
block of the others meets each block. Members of the largest component never meet each other, so no group is gathered in one task
and a large group that is mostly joined costs in proportion to its size.

Defined cases: as in ``simhash``; texts without words are copies of each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import spans
from footfall.llm.bbit_minhash import minima
from footfall.llm.book import small_batches, stored
from footfall.llm.components import components

BITS = 512
WORDS = BITS // 64
KEYS = 16
TAKEN = 4
MARGIN = 22
BUCKET = 1000
NEAREST = 4
PIVOTS = 16  # reference fingerprints of a group in the second round
BLOCK = 1 << 18  # shingles that meet each other, or as many others, in the second round
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.uint64(0x0101010101010101)


def shingles(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each shingle, and the number of shingles of each row."""
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = spans.owners(number)
    before = np.cumsum(number) - number
    first = (np.cumsum(counts) - counts)[owner] + np.arange(number.sum()) - before[owner]
    return first, first + np.minimum(counts, size)[owner] - 1, number


def bit_majorities(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Bit j is set if more than half of a row's hashes have it."""
    out = np.zeros(len(number), np.uint64)
    rows = np.flatnonzero(number)
    if not len(rows):
        return out
    # Eight bits are counted at once in byte lanes, over at most 255 hashes.
    parts = (number[rows] + 254) // 255
    owner = spans.owners(parts)
    inner = np.arange(parts.sum()) - (np.cumsum(parts) - parts)[owner]
    starts = (np.cumsum(number[rows]) - number[rows])[owner] + 255 * inner
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        ones = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        for byte in range(8):
            set_bits = 2 * spans.sums(ones[:, byte], parts) > number[rows]
            out[rows] |= set_bits.astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def radius(similarity: float, margin: int = MARGIN) -> int:
    """Bits in which fingerprints of texts with a Jaccard similarity may differ."""
    return round(BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi) + (margin if similarity < 1 else 0)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in order, and their number."""
    found, counted = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in spans.chunks(offsets):
        part = spans.LOWER[data[offsets[low]:offsets[high]]]
        text, starts, ends, counts = spans.spaced(part, offsets[low:high + 1] - offsets[low])
        first, last, number = shingles(counts, size)
        hashes, owner = spans.xxh64(text, starts[first], ends[last]), spans.owners(number)
        hashes = hashes[np.lexsort((hashes, owner))]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        found.append(hashes[fresh])
        counted.append(np.bincount(owner[fresh], minlength=high - low))
    return np.concatenate(found), np.concatenate(counted)


def set_fingerprints(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(rows, WORDS) unsigned longs."""
    out = np.zeros((len(number), WORDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            mixed = hashes + np.uint64(k + 1) * _STEP
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = bit_majorities(mixed ^ (mixed >> np.uint64(31)), number)
    return out


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """(rows, WORDS) unsigned longs."""
    return set_fingerprints(*shingle_sets(data, offsets, size))


def _longs(column: pa.Array) -> np.ndarray:
    data, _ = spans.text_bytes(column)
    return data.view("<u8").reshape(-1, WORDS)


def bucket_keys(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Buckets of each set of shingle hashes, (rows, KEYS)."""
    least = minima(hashes, number, KEYS * TAKEN).reshape(len(number), KEYS, TAKEN)
    with np.errstate(over="ignore"):
        keys = np.tile(np.arange(1, KEYS + 1, dtype=np.uint64) * _STEP, (len(number), 1))
        for k in range(TAKEN):
            keys = (keys ^ least[:, :, k]) * _STEP
            keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def bucket_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what pairs at most ``most`` bits apart connect."""
    links, left = [], np.arange(len(fps))
    while len(left) > 1:
        pivot, others = left[0], left[1:]
        distance = _apart(fps[pivot], fps[others])
        near = distance <= most
        links += [(int(pivot), int(x)) for x in others[near]]
        fringe = np.flatnonzero(~near & (distance <= 2 * most))
        for y in fringe:  # all farther members are excluded by their distance to the pivot
            some = near & (np.abs(distance - distance[y]) <= most)
            hit = np.flatnonzero(_apart(fps[others[some]], fps[others[y]]) <= most)
            if len(hit):
                links.append((int(others[some][hit[0]]), int(others[y])))
        left = others[~near]
    return links


def joining_links(fid: np.ndarray, label: np.ndarray, n: np.ndarray, fps: np.ndarray, hashes: np.ndarray, side: np.ndarray,
                  most: int, similarity: float) -> np.ndarray:
    """(2, links): verified links that join the labels of one block, or of two (``side`` 0 and 1), as all its pairs would.

    ``n`` and ``hashes`` are the sizes of the members' sets and the sets, one after the other.
    """
    label, pivots = label.copy(), fps[np.unique(np.linspace(0, len(fps) - 1, PIVOTS).astype(np.int64))]
    table = np.stack([_apart(p, fps) for p in pivots], axis=1)
    _, token = np.unique(hashes, return_inverse=True)
    begin, mark = np.cumsum(n) - n, np.zeros(len(token), bool)
    across = side.min() != side.max()
    values, counts = np.unique(label, return_counts=True)
    found = [np.zeros((2, 0), np.int64)]
    for x in np.flatnonzero(label != values[counts.argmax()]):  # one of two members with different labels is here
        some = (label != label[x]) & (np.minimum(n, n[x]) >= similarity * np.maximum(n, n[x]) * 0.999)
        if across:
            some &= side != side[x]
        y = np.flatnonzero(some)
        y = y[np.abs(table[y] - table[x]).max(axis=1) <= most]
        y = y[_apart(fps[x], fps[y]) <= most]
        if not len(y):
            continue
        own = token[begin[x]:begin[x] + n[x]]
        mark[own] = True
        ends = np.cumsum(n[y])
        both = np.add.reduceat(mark[token[np.arange(ends[-1]) + np.repeat(begin[y] - ends + n[y], n[y])]].astype(np.int64), ends - n[y])
        mark[own] = False
        y = y[both / (n[x] + n[y] - both) >= similarity]
        _, first = np.unique(label[y], return_index=True)
        found.append(np.stack([np.minimum(fid[x], fid[y[first]]), np.maximum(fid[x], fid[y[first]])]))
        label[np.isin(label, label[y])] = label[x]
    return np.concatenate(found, axis=1)


def bucket_members(fps: DataFrame, bucket: int) -> DataFrame:
    """(key, fid, blocks, block): the members of buckets with more than one."""
    listed = fps.select("fid", F.explode("keys").alias("key"))
    sizes = stored(listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    return stored(listed.join(sizes, "key").select("key", "fid", blocks.alias("blocks"), F.pmod(
        F.xxhash64("fid"), blocks).cast("int").alias("block")), "members")


def _grouped(members: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return members.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("members")).select("members")


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Begin and size of each list, and the flat members."""
    sizes = part.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes, part.column(0).flatten()


def star_links(fps: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """(pivot, fid, bits): links inside the blocks of buckets that connect what lies inside the radius there."""

    def inside(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            begin, sizes, flat = _lists(part)
            ids, longs = flat.field(0).to_numpy(), _longs(flat.field(1))
            with np.errstate(over="ignore"):  # the same texts become pivots in all tables
                rank = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
                rank = (rank ^ (rank >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            two = begin[sizes == 2]
            two = two[_apart(longs[two], longs[two + 1]) <= most]
            swap = rank[two] > rank[two + 1]
            found = [np.stack([two + swap, two + ~swap], axis=1)]
            for b, n in zip(begin[sizes > 2], sizes[sizes > 2]):
                order = b + np.argsort(rank[b:b + n])
                found.append(order[np.array(bucket_links(longs[order], most), np.int64).reshape(-1, 2)])
            a, b = np.concatenate(found).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a]), pa.array(ids[b]), pa.array(_apart(longs[a], longs[b]))], names=["pivot", "fid", "bits"])

    listed = members.join(fps.select("fid", "fp"), "fid")
    return _grouped(listed, ["key", "block"], ["fid", "fp"]).mapInArrow(inside, "pivot long, fid long, bits long").distinct()


def open_links(members: DataFrame, labels: DataFrame, sets: DataFrame, most: int, similarity: float, block: int) -> DataFrame:
    """(a, b): links that join what the verified pairs inside each bucket join.

    ``labels`` (fid, label) says what is joined already; ``sets`` is (fid, n, fp, hashes) of all texts that can have a link.
    """

    def inside(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [np.zeros((2, 0), np.int64)]
            for group in part.column(0):
                flat = group.values
                fid, label, n, side = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                hashes = spans.text_bytes(flat.field(5))[0].view("<u8")
                found.append(joining_links(fid, label, n, _longs(flat.field(4)), hashes, side, most, similarity))
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    labelled = stored(members.select("key", "fid").join(labels, "fid").join(sets.select("fid", "n"), "fid"), "labelled")
    sums = labelled.groupBy("key", "label").agg(F.sum("n").alias("n"))
    largest = F.max(F.struct("n", "label"))
    sums = sums.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), largest.alias("top")).where("parts > 1")
    cut = F.col("n") > block
    blocks_of = stored(sums.select(
        "key", F.when(cut, F.col("top.label")).alias("top"),
        F.when(cut, F.ceil(F.col("top.n") / block)).otherwise(0).cast("int").alias("tops"),
        F.when(cut, F.ceil((F.col("n") - F.col("top.n")) / block)).otherwise(1).cast("int").alias("others")), "open-buckets")
    # Blocks 0 to tops - 1 hold the largest component (if the bucket is cut), further ones the other members.
    is_top, mark = F.col("label").eqNullSafe(F.col("top")), F.xxhash64("fid")
    dealt = labelled.join(blocks_of, "key").withColumn("block", F.when(is_top, F.pmod(mark, "tops")).otherwise(
        F.col("tops") + F.pmod(mark, "others")).cast("int"))
    met = F.explode(F.sequence(F.when(is_top, F.col("tops")).otherwise(0), F.col("tops") + F.col("others") - 1)).alias("met")
    spread = dealt.select("key", "fid", "label", "block", met).select(
        "key", "fid", "label", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"),
        (F.col("block") > F.col("met")).cast("long").alias("side"))
    listed = spread.join(sets, "fid")
    groups = listed.groupBy("key", "i", "j").agg(F.collect_list(F.struct("fid", "label", "n", "side", "fp", "hashes")).alias("group"))
    return stored(groups.select("group").mapInArrow(inside, "a long, b long").distinct(), "open-links")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (fid, hashes) have the similarity or more."""

    def check(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            (left, begin), (right, start) = (spans.text_bytes(part.column(k)) for k in (2, 3))
            keep = np.zeros(part.num_rows, bool)
            for r in range(part.num_rows):
                x, y = left[begin[r]:begin[r + 1]].view("<u8"), right[start[r]:start[r + 1]].view("<u8")
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)) * 0.999:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[r] = both >= 1 and both / (len(x) + len(y) - both) >= similarity
            yield part.select(["a", "b"]).filter(pa.array(keep))

    one, two = (sets.select(F.col("fid").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long"), "verified")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text: str = "text",
                bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of each row; ids may be of any type that has an order."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes, number = shingle_sets(*spans.text_bytes(part.column(3)), size)
            raw = set_fingerprints(hashes, number).astype("<u8").tobytes()
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), part.num_rows, [None, pa.py_buffer(raw)])
            ends = np.cumsum(number)
            digests = [hashlib.blake2b(hashes[e - n:e].tobytes(), digest_size=16).digest() for e, n in zip(ends, number)]
            keys = pa.FixedSizeListArray.from_arrays(pa.array(bucket_keys(hashes, number).ravel()), KEYS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests, pa.binary()), packed.cast(pa.binary()), keys],
                                             names=["id", "t1", "t2", "digest", "fp", "keys"])

    def as_sets(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes, number = shingle_sets(*spans.text_bytes(part.column(1)), size)
            ends = np.cumsum(number)
            made = [hashes[e - n:e].astype("<u8").tobytes() for e, n in zip(ends, number)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["fid", "hashes"])

    kind = docs.schema[id_column].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("t1"), F.xxhash64(body, F.lit(1)).alias("t2"), body.alias("body"))
    marked = stored(texts.mapInArrow(batches, f"id {kind}, t1 long, t2 long, digest binary, fp binary, keys array<long>"), "long-fingerprints")
    fps = marked.groupBy("digest").agg(F.min("id").alias("first_id"), F.min(F.struct("t1", "t2")).alias("t"), F.min("fp").alias("fp"),
                                       F.first("keys").alias("keys"))
    fps = stored(fps.withColumn("fid", F.monotonically_increasing_id()), "distinct-long-fingerprints")

    most = radius(similarity)
    members = bucket_members(fps, bucket)
    stars = stored(star_links(fps, members, most), "stars")
    # Whatever can be in a pair: texts with a link, and those whose bucket was linked block by block.
    needed = stars.select("fid").union(stars.select("pivot")).union(members.where("blocks > 1").select("fid")).distinct()
    needed = stored(fps.join(needed, "fid").select("fid", "t.t1", "t.t2"), "needed")
    one_of = texts.select("t1", "t2", "body").join(needed, ["t1", "t2"]).groupBy("fid").agg(F.first("body").alias("body"))
    sets = one_of.mapInArrow(as_sets, "fid long, hashes binary").join(fps.select("fid", "fp"), "fid")
    sets = stored(sets.select("fid", (F.length("hashes") / 8).cast("long").alias("n"), "fp", "hashes"), "sets")

    nearest = stars.groupBy("fid").agg(F.slice(F.sort_array(F.collect_list(F.struct("bits", "pivot"))), 1, NEAREST).alias("links"))
    nearest = nearest.select(F.explode("links").alias("link"), "fid").select(
        F.least("fid", "link.pivot").alias("a"), F.greatest("fid", "link.pivot").alias("b")).distinct()
    edges = verified(nearest, sets, similarity)
    joined = components(edges).select(F.col("node").alias("fid"), "root")
    labels = stored(fps.select("fid").join(joined, "fid", "left").select("fid", F.coalesce("root", "fid").alias("label")), "first-labels")
    more = open_links(members, labels, sets.where("n > 0"), most, similarity, block)
    roots = components(edges.union(more)).select(F.col("node").alias("fid"), "root")
    placed = fps.join(roots, "fid", "left").withColumn("root", F.coalesce("root", "fid"))
    heads = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = stored(placed.join(heads, "root").select("digest", "component_id"), "labels")
    return marked.join(labels, "digest").select(F.col("id").alias(id_column), "component_id")

"""Suffix-array removal of repeated passages: every byte covered by an ``LENGTH``-byte string that also starts elsewhere.

Not all suffixes are sorted. Of every ``span`` possible start positions the one with the smallest hash of its first bytes is
the anchor (leftmost if equal), so equal strings have equal anchors. An anchor stands for the run of strings that
chose it, and its suffix is sorted by: its leading tokens, a hash of the bytes that all of its strings have from the
anchor on, and a hash of the bytes of the whole run. Sampled splitters over these keys (ties broken by place, so a passage
in a third of all documents spreads over buckets) range-partition the suffixes; each bucket is sorted by multikey
quicksort and neighbours are compared; what the first and last groups of a bucket leave open is settled with
the groups of other buckets.

* Equal whole runs: all strings of the run are repeated.
* Equal shared bytes, different runs: the runs' bytes are fetched, and each of their strings is compared inside the group.
  Groups with more than ``GROUP`` different runs are compared string by string in a shuffle of string hashes instead.
* Neither: nothing that chose this anchor is repeated.

Hashes are 64-bit and only compared together with their group's. Texts are cut into pieces of ``PIECE`` start positions that
overlap by one string, so a very long text needs no more memory than others.

By words (``repeated_words``), a text is the sequence of its words' codes of ``CODE`` bytes each, and strings are ``WORDS`` codes that begin
with a word; white space between words plays no part there.

Defined cases: null text is empty; texts shorter than ``LENGTH`` bytes keep everything; repeated rows repeat each other's
strings, whatever their ids; each row gets a row. Removing bytes can cut a character in two; as text, such halves go too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import spans
from footfall.llm.book import small_batches, stored

LENGTH = 400
GRAM = 16
WORDS = 51  # the shortest run of words that is a passage by words
CODE = 4  # bytes that stand for a word
LEAD = 24
GROUP = 2000
PIECE = 1 << 20
TOGETHER = 1 << 16  # bytes of short texts that are hashed at once: their hashes stay in a core's cache
SMALL = 2048

# Odd multipliers, fixed so that all tasks agree.
_A, _B, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_SIGN = np.uint64(1 << 63)
_RI = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))


def span(length: int) -> int:
    """Start positions that one anchor is chosen from; all strings of a run have the other ``length - span`` bytes from the anchor on."""
    return length * 4 // 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^k and r^-k for k < n, modulo 2^64."""
    size = max((s for s in _powers if s >= n), default=0)
    if not size:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_R, _RI):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers.clear()
        _powers[size] = tuple(tables)
    return _powers[size]


class Hashes:
    """Hashes of spans of at least ``GRAM`` bytes of one piece of text; where a span lies does not matter."""

    def __init__(self, piece: np.ndarray):
        n = len(piece) - GRAM + 1
        padded = np.concatenate([piece, np.zeros(8, np.uint8)])
        longs = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        with np.errstate(over="ignore"):
            self.grams = _mix(longs[:n] * _A ^ _mix(longs[8:n + 8] + _B))
            powers, self._back = _power_tables(n + 1)
            self._sum = np.zeros(n + 1, np.uint64)
            np.cumsum(self.grams * powers[:n], out=self._sum[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self._sum[ends - GRAM + 1] - self._sum[starts]) * self._back[starts])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:have - width], values[width - have:]) if have < width else values


def anchors(text: np.ndarray, bounds: np.ndarray, hashes: Hashes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and number of starts of each run of strings in a part of a text that holds one piece or several."""
    place = np.arange(len(hashes.grams), dtype=np.uint64)
    ranked = (hashes.grams & ~np.uint64((1 << 24) - 1)) | place  # the place breaks ties: leftmost first
    chosen = (_least(ranked, span(length))[:len(text) - length + 1] & np.uint64((1 << 24) - 1)).astype(np.int64)
    for end in bounds[1:-1]:  # no string crosses from one piece to the next
        chosen[max(0, end - length + 1):end] = -1
    first = np.flatnonzero(np.diff(chosen, prepend=-2))
    starts = np.diff(np.append(first, len(chosen)))
    inside = chosen[first] >= 0
    return chosen[first[inside]], first[inside], starts[inside]


def pieces(offsets: np.ndarray, size: int, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch of texts that are hashed at once: the bounds of their pieces, and each piece's row and begin in its text.

    Short texts share a part, up to ``TOGETHER`` bytes; a longer one is cut into pieces with ``size`` start positions each, alone in their parts.
    """
    for low, high in spans.chunks(offsets, min(size, TOGETHER)):
        if high - low > 1:
            yield offsets[low:high + 1], np.arange(low, high), np.zeros(high - low, np.int64)
            continue
        for begin in range(0, int(offsets[high] - offsets[low]) - length + 1, size):
            at = offsets[low] + begin
            yield np.array([at, min(at + size + length - 1, offsets[high])]), np.array([low]), np.array([begin])


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their tokens, three-way partitioned token by token."""
    order = np.arange(len(columns[0]))
    open_parts = [(0, len(order), 0)]
    while open_parts:
        low, high, depth = open_parts.pop()
        if high - low < 2 or depth == len(columns):
            continue
        part = order[low:high]
        if high - low <= SMALL:
            order[low:high] = part[np.lexsort([c[part] for c in columns[:depth - 1 if depth else None:-1]])]
            continue
        keys = columns[depth][part]
        pivot = np.sort(keys[::max(1, len(keys) // 9)])[4]
        less, same = keys < pivot, keys == pivot
        more = ~(less | same)
        order[low:high] = np.concatenate([part[less], part[same], part[more]])
        a = low + int(less.sum())
        b = a + int(same.sum())
        open_parts += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """The documents with two hashes that identify a row, up to rows that are equal anyway."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("body", body).withColumns({
        "id1": F.xxhash64(F.col(id_column).cast("string"), F.lit(1)), "id2": F.xxhash64("body")})


def _suffixes(keyed: DataFrame, size: int, length: int = LENGTH) -> DataFrame:
    """(lead, f, h, id1, id2, first, size): the suffix key of each anchor and its run of strings."""

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = spans.text_bytes(part.column(2))
            found = []
            for bounds, rows, begins in pieces(offsets, size, length):
                text, bounds = data[bounds[0]:bounds[-1]], bounds - bounds[0]
                if len(text) < length:
                    continue
                hashes = Hashes(text)
                at, first, starts = anchors(text, bounds, hashes, length)
                if not len(at):
                    continue
                shared = hashes.of(at, at + length - span(length))
                whole = hashes.of(first, first + starts - 1 + length)
                with np.errstate(over="ignore"):
                    whole = _mix(whole ^ _mix(((at - first) << 20 | starts).astype(np.uint64) * _A))
                lead = text[at[:, None] + np.arange(LEAD)]
                k = np.searchsorted(bounds, first, "right") - 1
                found.append((lead, shared, whole, first - bounds[k] + begins[k], starts, rows[k]))
            if not found:
                continue
            lead, shared, whole, first, starts, rows = (np.concatenate(c) for c in zip(*found))
            rows = pa.array(rows)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LEAD), len(lead), [None, pa.py_buffer(lead.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [packed.cast(pa.binary()), pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64)),
                 part.column(0).take(rows), part.column(1).take(rows), pa.array(first), pa.array(starts.astype(np.int32))],
                names=["lead", "f", "h", "id1", "id2", "first", "size"])

    return keyed.select("id1", "id2", "body").where(F.octet_length("body") >= length).mapInArrow(
        batches, "lead binary, f long, h long, id1 long, id2 long, first long, size int")


REPEATED, OPEN_RUN, PARTNER, AT_EDGE = range(4)


def _compared(suffixes: DataFrame) -> DataFrame:
    """(kind, f, h, n, id1, id2, first, size): what sorting shows of each suffix that is not alone."""

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(parts)) if (parts := list(parts)) else None
        if whole is None or not whole.num_rows:
            return
        whole = whole.combine_chunks()
        data, _ = spans.text_bytes(whole["lead"].chunk(0))
        tokens = data.reshape(-1, LEAD).view(">u8")
        f, h = (whole[c].to_numpy().view(np.uint64) for c in ("f", "h"))
        # Spark deals out f and h as signed numbers: in another order, the parts of a group split over buckets would not be at the edges.
        order = multikey_quicksort([np.ascontiguousarray(tokens[:, k]).astype(np.uint64) for k in range(LEAD // 8)] + [f ^ _SIGN, h ^ _SIGN])
        lead, f, h = tokens[order], f[order], h[order]
        fresh_group = np.append(True, (lead[1:] != lead[:-1]).any(axis=1) | (f[1:] != f[:-1]))
        fresh_run = fresh_group | np.append(True, h[1:] != h[:-1])
        group, run = np.cumsum(fresh_group) - 1, np.cumsum(fresh_run) - 1
        copies = np.bincount(run)[run]
        kinds = np.bincount(group[fresh_run])[group]
        at_edge = (group == 0) | (group == group[-1])
        out = []
        for kind, rows in ((REPEATED, copies > 1), (OPEN_RUN, (copies == 1) & (kinds > 1) & ~at_edge),
                           (PARTNER, (copies > 1) & fresh_run & (kinds > 1) & ~at_edge), (AT_EDGE, fresh_run & at_edge)):
            rows = np.flatnonzero(rows)
            taken = whole.select(["id1", "id2", "first", "size"]).take(order[rows])
            out.append(pa.table({"kind": np.full(len(rows), kind, np.int32), "f": f[rows].view(np.int64),
                                 "h": h[rows].view(np.int64), "n": copies[rows].astype(np.int64),
                                 **{c: taken[c] for c in taken.column_names}}))
        yield from pa.concat_tables(out).combine_chunks().to_batches()

    ranged = suffixes.repartitionByRange("lead", "f", "h", "id1", "id2", "first")
    return ranged.mapInArrow(batches, "kind int, f long, h long, n long, id1 long, id2 long, first long, size int")


def _settled(compared: DataFrame) -> DataFrame:
    """The same without ``AT_EDGE``: groups that touch a bucket's edge are joined with their parts in other buckets."""
    edge = compared.where(F.col("kind") == AT_EDGE).drop("kind")
    runs = edge.groupBy("f", "h").agg(F.sum("n").alias("copies"))
    groups = runs.groupBy("f").agg(F.count("*").alias("kinds"))
    joined = edge.join(runs, ["f", "h"]).join(groups, "f")
    outcome = F.array_compact(F.array(
        F.when((F.col("n") == 1) & (F.col("copies") > 1), F.lit(REPEATED)),
        F.when((F.col("copies") == 1) & (F.col("kinds") > 1), F.lit(OPEN_RUN)),
        F.when((F.col("copies") > 1) & (F.col("kinds") > 1), F.lit(PARTNER))))
    return compared.where(F.col("kind") != AT_EDGE).unionByName(
        joined.select(F.explode(outcome).alias("kind"), "f", "h", "n", "id1", "id2", "first", "size"))


def _string_hashes(text: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ``length``-byte strings of consecutive runs of bytes."""
    out = [np.zeros(0, np.uint64)]
    for low, high in spans.chunks(bounds, TOGETHER):
        hashes = Hashes(text[bounds[low]:bounds[high]])
        number = np.diff(bounds[low:high + 1]) - length + 1
        row = spans.owners(number)
        starts = np.arange(number.sum()) + (bounds[low:high] - bounds[low] - (np.cumsum(number) - number))[row]
        out.append(hashes.of(starts, starts + length))
    return np.concatenate(out)


def _stretches(hit: np.ndarray, row: np.ndarray, start: np.ndarray, length: int):
    """Row, begin and end of the text covered by neighbouring strings that are hits."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.append(True, (np.diff(at) > 1) | (np.diff(row[at]) != 0))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return row[at[first]], start[at[first]], start[at[last]] + length


def _in_groups(length: int, parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (f, id1, id2, first, open, body) sorted by f: the stretches of open runs that have a partner in their group."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        text, bounds = spans.text_bytes(table["body"].chunk(0))
        number = np.diff(bounds) - length + 1
        row = spans.owners(number)
        inner = np.arange(number.sum()) - (np.cumsum(number) - number)[row]
        with np.errstate(over="ignore"):
            key = _string_hashes(text, bounds, length) ^ _mix(table["f"].to_numpy().view(np.uint64) * _A)[row]
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        wanted = table["open"].to_numpy(zero_copy_only=False)[row]
        rows, begin, end = _stretches((counts[back] > 1) & wanted, row, table["first"].to_numpy()[row] + inner, length)
        taken = table.select(["id1", "id2"]).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([taken["id1"].combine_chunks(), taken["id2"].combine_chunks(), pa.array(begin),
                                           pa.array(end)], names=["id1", "id2", "begin", "end"])

    held: list[pa.Table] = []
    size = 0
    for part in parts:
        held.append(pa.Table.from_batches([part]))
        size += part.nbytes
        if size > spans.CHUNK:  # all groups but the last are complete
            table = pa.concat_tables(held).combine_chunks()
            f = table["f"].to_numpy()
            cut = int(np.flatnonzero(f != f[-1])[-1]) + 1 if (f != f[-1]).any() else 0
            if cut:
                yield compare(table.slice(0, cut))
            held, size = [table.slice(cut)], 0
    if held and sum(t.num_rows for t in held):
        yield compare(pa.concat_tables(held))


_FETCHED = "f long, h long, id1 long, id2 long, first long, open boolean, body binary"


def _fetch(length: int, parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs listed with each document."""
    for part in parts:
        data, offsets = spans.text_bytes(part.column(part.schema.get_field_index("body")))
        lists = part.column(part.schema.get_field_index("runs"))
        row = spans.owners(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        runs = lists.flatten()
        first, size = (runs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
        low = offsets[row] + first
        high = low + size - 1 + length
        for k in range(0, len(row), 4096):
            some = slice(k, k + 4096)
            body = pa.array([data[a:b].tobytes() for a, b in zip(low[some], high[some])], pa.binary())
            n, at = len(body), pa.array(row[some])
            yield pa.RecordBatch.from_arrays(
                [runs.field(0).slice(k, n), runs.field(1).slice(k, n),
                 part.column(part.schema.get_field_index("id1")).take(at), part.column(part.schema.get_field_index("id2")).take(at),
                 runs.field(3).slice(k, n), runs.field(2).slice(k, n), body],
                names=["f", "h", "id1", "id2", "first", "open", "body"])


def _by_string(length: int, parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, open, id1, id2, start): every string of crowded groups."""
    for part in parts:
        for k in range(0, part.num_rows, 1000):
            table = pa.Table.from_batches([part.slice(k, 1000)]).combine_chunks()
            text, bounds = spans.text_bytes(table["body"].chunk(0))
            number = np.diff(bounds) - length + 1
            row = spans.owners(number)
            inner = np.arange(number.sum()) - (np.cumsum(number) - number)[row]
            with np.errstate(over="ignore"):
                key = _string_hashes(text, bounds, length) ^ _mix(table["f"].to_numpy().view(np.uint64) * _A)[row]
            taken = table.select(["open", "id1", "id2"]).take(pa.array(row)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), *(taken[c].chunk(0) for c in taken.column_names),
                 pa.array(table["first"].to_numpy()[row] + inner)], names=["g", "open", "id1", "id2", "start"])


def repeated_stretches(keyed: DataFrame, group: int = GROUP, piece: int = PIECE, length: int = LENGTH) -> DataFrame:
    """(id1, id2, begin, end): stretches of text, overlapping ones among them, that repeated strings of ``length`` bytes cover."""
    found = stored(_settled(stored(_compared(_suffixes(keyed, piece, length)), "compared")), "settled")
    covered = found.where(F.col("kind") == REPEATED).select(
        "id1", "id2", F.col("first").alias("begin"), (F.col("first") + F.col("size") - 1 + length).alias("end"))

    unsettled = found.where(F.col("kind").isin(OPEN_RUN, PARTNER))
    crowded = stored(unsettled.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > group).select("f"), "crowded")
    # Repeated rows (one id, one text) have the same runs, which are listed once.
    listed = unsettled.groupBy("id1", "id2").agg(F.collect_set(F.struct(
        "f", "h", (F.col("kind") == OPEN_RUN).alias("open"), "first", "size")).alias("runs"))
    runs = stored(keyed.join(listed.hint("shuffle_hash"), ["id1", "id2"]).mapInArrow(partial(_fetch, length), _FETCHED), "runs")
    small = runs.join(crowded, "f", "left_anti").drop("h").repartition("f").sortWithinPartitions("f")
    in_groups = small.select("f", "id1", "id2", "first", "open", "body").mapInArrow(
        partial(_in_groups, length), "id1 long, id2 long, begin long, end long")

    strings = runs.join(crowded, "f", "left_semi").mapInArrow(partial(_by_string, length), "g long, open boolean, id1 long, id2 long, start long")
    more_than_one = strings.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    by_string = strings.where("open").join(more_than_one, "g").select(
        "id1", "id2", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))
    return covered.union(in_groups).union(by_string)


def repeated_words(keyed: DataFrame, words: int = WORDS) -> DataFrame:
    """(id1, id2, begin, end): stretches of words that repeated runs of ``words`` words cover."""

    def codes(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = spans.text_bytes(part.column(2))
            made, numbers = [b""], [np.zeros(0, np.int64)]
            for low, high in spans.chunks(offsets, PIECE):
                some = data[offsets[low]:offsets[high]]
                starts, ends, counts = spans.words(some, offsets[low:high + 1] - offsets[low])
                made.append(spans.xxh64(some, starts, ends).astype("<u4").tobytes())
                numbers.append(counts)
            raw, counts = b"".join(made), np.concatenate(numbers)
            at = pa.array(np.concatenate([[0], np.cumsum(CODE * counts)]), pa.int64())
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, at.buffers()[1], pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made.cast(pa.binary())], names=["id1", "id2", "body"])

    coded = keyed.select("id1", "id2", "body").mapInArrow(codes, "id1 long, id2 long, body binary")
    found = repeated_stretches(coded, length=CODE * words)
    # All strings that begin in a stretch are repeated; those that begin with a word count.
    first, last = F.ceil(F.col("begin") / CODE), F.floor((F.col("end") - CODE * words) / CODE)
    return found.select("id1", "id2", first.alias("begin"), (last + words).alias("end")).where(F.col("end") - words >= F.col("begin"))


def in_bytes(bodies: pa.Array, lists: pa.Array) -> pa.Array:
    """Stretches (begin, end, words), of which some count words, as stretches of bytes."""
    data, offsets = spans.text_bytes(bodies)
    starts, ends, counts = spans.words(data, offsets)
    number = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, flat = spans.owners(number), lists.flatten()
    begin, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    some = flat.field(2).to_numpy(zero_copy_only=False).astype(bool)
    base = (np.cumsum(counts) - counts)[row[some]]
    begin[some] = starts[base + begin[some]] - offsets[row[some]]
    end[some] = ends[base + end[some] - 1] - offsets[row[some]]
    pairs = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), pairs)


def _covered(length: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def cut_rows(bodies: pa.Array, lists: pa.Array) -> Iterator[tuple[bytes, int, int, int]]:
    """What is left of each text, its bytes, removed bytes and removed runs; ``lists``: covered stretches (begin, end)."""
    data, offsets = spans.text_bytes(bodies)
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    begin, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    for r in range(len(bodies)):
        body = data[offsets[r]:offsets[r + 1]]
        if not counts[r]:
            yield body.tobytes(), len(body), 0, 0
            continue
        gone = _covered(len(body), begin[at[r]:at[r + 1]], end[at[r]:at[r + 1]])
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        yield body[~gone].tobytes(), len(body), int(gone.sum()), runs


def _united(lists: pa.Array) -> np.ndarray:
    """How many places the stretches (begin, end) of each row cover."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(counts)])
    begin, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    out = np.zeros(len(lists), np.int64)
    for r in np.flatnonzero(counts):
        some = slice(at[r], at[r + 1])
        out[r] = _covered(int(end[some].max()), begin[some], end[some]).sum()
    return out


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", group: int = GROUP,
                    piece: int = PIECE, words: int | None = None) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the remaining text.

    ``words`` adds n_run_words: how many words of the text lie in runs of so many words that also start elsewhere, by words; they stay.
    """
    small_batches(docs.sparkSession)
    marked = keyed(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").drop("text")
    # Repeated rows (one id, one text) have the same stretches, which are listed once.
    spans_of = repeated_stretches(marked, group, piece).groupBy("id1", "id2").agg(
        F.collect_set(F.struct("begin", "end")).alias("spans"))
    runs_of = None if words is None else repeated_words(marked, words).groupBy("id1", "id2").agg(
        F.collect_set(F.struct("begin", "end")).alias("runs"))

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(size, gone, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"))
                    for left, size, gone, runs in cut_rows(part.column(1), part.column(2))]
            made = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            if words is not None:
                made.append(pa.array(_united(part.column(3))))
                names.append("n_run_words")
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=names)

    kind = marked.schema["doc_id"].dataType.simpleString()
    joined = marked.join(spans_of.hint("shuffle_hash"), ["id1", "id2"], "left")
    if runs_of is not None:
        joined = joined.join(runs_of.hint("shuffle_hash"), ["id1", "id2"], "left")
    result = joined.select("doc_id", "body", "spans", *(["runs"] if runs_of is not None else [])).mapInArrow(
        batches, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
        + (", n_run_words long" if words is not None else ""))
    return result.withColumnRenamed("doc_id", id_column)

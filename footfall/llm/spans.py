"""Whole Arrow batches of texts as one byte array: words, shingles and their XXH64, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

PART = np.zeros(256, bool)  # bytes of letters and digits
PART[0x80:] = True
PART[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True

CHUNK = 4 << 20  # bytes of text handled at once; a longer text is a chunk of its own

# Fixed values of the XXH64 specification.
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``size`` bytes together, or of one longer row."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high
        low = high


def plain(data: np.ndarray) -> np.ndarray:
    """A-Z in small letters and a space for every byte that is no letter, digit or part of another script."""
    return np.where(PART[data], LOWER[data], 0x20).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the number of words of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows, each followed by one space: bytes, word starts, word ends, words of each row."""
    starts, ends, counts = words(data, offsets)
    lengths = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=to[1:])
    out = np.full(to[-1], 0x20, np.uint8)
    if len(starts):
        inside = ~SPACE[data]
        at = np.ones(to[-1], bool)
        at[to[1:] - 1] = False
        out[at] = data[inside]
    return out, to[:-1], to[1:] - 1, counts


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def _hash_of_length(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of all spans of one length; ``data`` has eight spare bytes at its end."""
    longs = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    ints = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    s, k = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        if length >= 32:
            acc = [np.full(len(at), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while k + 32 <= length:
                for j in range(4):
                    acc[j] = _round(acc[j], longs[at + (k + 8 * j)])
                k += 32
            h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        else:
            h = np.full(len(at), s + _P5, np.uint64)
        h = h + np.uint64(length)
        while k + 8 <= length:
            h = _rot(h ^ _round(np.uint64(0), longs[at + k]), 27) * _P1 + _P4
            k += 8
        if k + 4 <= length:
            h = _rot(h ^ ints[at + k].astype(np.uint64) * _P1, 23) * _P2 + _P3
            k += 4
        while k < length:
            h = _rot(h ^ data[at + k].astype(np.uint64) * _P5, 11) * _P1
            k += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of bytes, all spans of one length together."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, 512).astype(np.int16), kind="stable")
    sizes = np.minimum(lengths[order], 512)
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(order)]):
        rows = order[low:high]
        length = int(sizes[low])
        if length < 512 and high - low > 8:
            out[rows] = _hash_of_length(padded, starts[rows], length, seed)
        else:
            for r in rows:
                out[r] = xxhash.xxh64_intdigest(padded[starts[r]:ends[r]].tobytes(), seed)
    return out


def owners(counts: np.ndarray) -> np.ndarray:
    """The row of each item, given the number of items of each row."""
    return np.repeat(np.arange(len(counts)), counts)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each row's consecutive items."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]

"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Words are runs of letters, digits and other scripts in small letters; distance is the number of word edits. A document holds
an item if some stretch of it is within ``rate`` edits per word of the item (a fifth: similarity of 0.8 or more).

Windows begin at every word. Item lengths are cut into classes that grow by a quarter; a window has the
length of its class, and an item is compared by its first words of that number. In turn:

1. k edits leave all but 2k of an item's word pairs as they are, so a window in which fewer pairs occur in any item of the class
   cannot be near one (no match is lost here).
2. The CGK walk copies the word it stands on at each of 3w steps and moves on or stays by a random bit of the step and the word;
   strings k edits apart mostly give walks O(k^2) apart in Hamming distance. Each of ``REPEATS`` walks is sampled
   at ``SAMPLE`` steps; a window and an item whose samples agree in one of the walks are candidates.
3. Candidates are verified by the edit distance of the whole item, with a free end in the document.

Walks of long items drift apart, so an item of more than ``LONGEST`` words is cut into equal pieces of no more: if it is held with few
enough edits, one of its pieces is, and usually several are. The windows that are candidates for a piece tell where the item
can begin, up to its edits, and all of these beginnings are verified against the whole item at once.

Items are sent to the tasks in blocks of about ``BLOCK_BYTES`` of text, one pass over the documents each.

Defined cases: null texts and items hold nothing; items with fewer than ``MIN_WORDS`` words take no part; repeated rows and
repeated items are each compared. The result has one row per document row and item row that it holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import spans
from footfall.llm.book import small_batches

RATE = 0.2
MIN_WORDS = 5
GROWTH = 1.25
SAMPLE = 3
REPEATS = 48
BLOCK_BYTES = 4 << 20
LONGEST = 64
WINDOWS = 2048  # windows walked at once
_M = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M
        return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each row."""
    plain = spans.plain(data)
    starts, ends, counts = spans.words(plain, offsets)
    return spans.xxh64(plain, starts, ends), counts


def _pairs(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(words[:-1] * np.uint64(3) + words[1:])


class SizeClass:
    """Items of similar length: their word pairs and the samples of their walks."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], rate: float, repeats: int, sample: int, seed: int):
        self.width, self.items, self.repeats = width, items, repeats
        self.edits = max(math.floor(rate * len(words)) for _, words in items)
        self.reach = width + self.edits
        self.needed = width - 1 - 2 * self.edits
        pairs = np.unique(np.concatenate([_pairs(words[:width]) for _, words in items]))
        self.shift = np.uint64(64 - max(16, math.ceil(math.log2(64 * len(pairs)))))
        self.known = np.zeros(1 << int(np.uint64(64) - self.shift), bool)
        self.known[pairs >> self.shift] = True
        rng = np.random.default_rng((seed, width))
        steps = 3 * width
        self.turns = rng.integers(0, 1 << 63, (steps, repeats), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sampled = np.zeros((steps, repeats), bool)
        for r in range(repeats):
            self.sampled[np.sort(rng.choice(2 * width, min(sample, 2 * width), replace=False)), r] = True
        text = np.concatenate([words[:self.reach] for _, words in items] + [np.zeros(0, np.uint64)])
        sizes = np.array([min(len(words), self.reach) for _, words in items])
        keys = self.walk(text, np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(keys, axis=None, kind="stable")
        self.keys, self.of = keys.ravel()[order], np.tile(np.arange(len(items)), (repeats, 1)).ravel()[order]

    def walk(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sampled symbols of all walks over stretches of words, hashed: (repeats, stretches)."""
        padded = np.append(words, np.uint64(0))
        place = np.zeros((self.repeats, len(starts)), np.int64)
        out = np.repeat(np.arange(self.repeats, dtype=np.uint64)[:, None], len(starts), axis=1)
        last = int(np.flatnonzero(self.sampled.any(axis=1))[-1])
        with np.errstate(over="ignore"):
            for step in range(last + 1):
                symbol = np.where(place < sizes, padded[np.minimum(starts + place, len(words))], np.uint64(0))
                taken = self.sampled[step]
                if taken.any():
                    out[taken] = _mix(out[taken] * np.uint64(5) + symbol[taken])
                place += (_mix(symbol) * self.turns[step][:, None] >> np.uint64(63)).astype(np.int64)
        return out

    def windows(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of windows that share enough word pairs with the class; ``ends``: where each word's row ends."""
        if len(words) < 2:
            return np.zeros(0, np.int64)
        hit = np.concatenate([[0], np.cumsum(self.known[_pairs(words) >> self.shift])])
        start = np.arange(len(words))
        until = np.minimum(start + self.reach, ends) - 1  # pairs begin at all words but the last
        enough = hit[np.maximum(until, start)] - hit[start] >= max(self.needed, 0)
        return start[enough & (ends - start >= self.width - self.edits)]

    def candidates(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) pairs that agree in one walk."""
        found = [np.zeros((2, 0), np.int64)]
        for k in range(0, len(starts), WINDOWS):
            some = starts[k:k + WINDOWS]
            keys = self.walk(words, some, np.minimum(self.reach, ends[some] - some))
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            number = (high - low).ravel()
            if number.any():
                at = np.repeat(low.ravel(), number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                window = np.repeat(np.tile(some, self.repeats), number)
                found.append(np.unique(np.stack([window, self.of[at]]), axis=1))
        window, item = np.concatenate(found, axis=1)
        return window, item


def distances(item: np.ndarray, stretches: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edits from the item to the nearest beginning of each row of words, of which the first ``sizes`` count."""
    width = stretches.shape[1]
    column = np.arange(width + 1)
    beyond = column > sizes[:, None]
    row = np.repeat(column[None, :], len(stretches), axis=0)
    for n, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = n
        new[:, 1:] = np.minimum(row[:, :-1] + (stretches != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - column, axis=1) + column
    return np.where(beyond, len(item) + width, row).min(axis=1)


def edits_by_start(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Edits from the item to the nearest stretch that begins at each word, or at the end, of a row of words."""
    column = np.arange(len(words) + 1)
    back, row = words[::-1], np.zeros(len(words) + 1, np.int64)
    for n, word in enumerate(item[::-1], 1):
        new = np.empty_like(row)
        new[0] = n
        new[1:] = np.minimum(row[:-1] + (back != word), row[1:] + 1)
        row = np.minimum.accumulate(new - column) + column
    return row[::-1]


class Index:
    """All classes of a block of items."""

    def __init__(self, texts: list[str], rate: float = RATE, repeats: int = REPEATS, sample: int = SAMPLE,
                 min_words: int = MIN_WORDS, seed: int = 0):
        self.rate = rate
        data, offsets = spans.text_bytes(pa.array(texts, pa.large_string()))
        hashes, counts = word_hashes(data, offsets)
        ends = np.cumsum(counts)
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.whole: dict[int, np.ndarray] = {}
        self.pieces: list[tuple[int, int]] = []  # item and first word of each piece
        for n, (high, count) in enumerate(zip(ends, counts)):
            if count >= min_words:
                self.whole[n] = hashes[high - count:high]
                parts = -(-int(count) // max(LONGEST, min_words))
                bounds = [int(count) * k // parts for k in range(parts + 1)]
                for low, until in zip(bounds[:-1], bounds[1:]):
                    width = min_words
                    while math.ceil(width * GROWTH) <= until - low:
                        width = math.ceil(width * GROWTH)
                    classes.setdefault(width, []).append((len(self.pieces), self.whole[n][low:until]))
                    self.pieces.append((n, low))
        self.classes = [SizeClass(w, items, rate, repeats, sample, seed) for w, items in sorted(classes.items())]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, words of the item, first word) of the best stretch of each row for each item it holds."""
        words, counts = word_hashes(data, offsets)
        owner = spans.owners(counts)
        ends = np.cumsum(counts)[owner]
        begins = np.cumsum(counts) - counts
        best: dict[tuple[int, int], tuple[int, int]] = {}
        long: dict[tuple[int, int], list[int]] = {}
        for size in self.classes:
            window, item = size.candidates(words, size.windows(words, ends), ends)
            for k in np.unique(item):
                piece, own = size.items[k]
                number, low = self.pieces[piece]
                if len(own) < len(self.whole[number]):
                    for at in window[item == k]:
                        long.setdefault((int(owner[at]), number), []).append(int(at) - low)
                    continue
                allowed = math.floor(self.rate * len(own))
                reach = len(own) + allowed
                starts = window[item == k]
                for at in np.array_split(starts, -(-len(starts) * reach // 2_000_000)):
                    index = at[:, None] + np.arange(reach)
                    sizes = np.minimum(reach, ends[at] - at)
                    edits = distances(own, words[np.minimum(index, len(words) - 1)], sizes)
                    for s, e in zip(at[edits <= allowed], edits[edits <= allowed]):
                        key, value = (int(owner[s]), number), (int(e), int(s))
                        best[key] = min(best.get(key, value), value)
        for (r, number), starts in long.items():
            own = self.whole[number]
            allowed = math.floor(self.rate * len(own))
            starts = np.unique(starts)
            for some in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * allowed + 1) + 1):
                low = max(int(begins[r]), int(some[0]) - allowed)
                high = min(int(begins[r] + counts[r]), int(some[-1]) + 2 * allowed + len(own))
                edits = edits_by_start(own, words[low:high])
                value = int(edits.min()), low + int(edits.argmin())
                if value[0] <= allowed:
                    best[r, number] = min(best.get((r, number), value), value)
        return [(row, n, edits, len(self.whole[n]), s - int(begins[row])) for (row, n), (edits, s) in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, repeats: int = REPEATS, id_column: str = "doc_id",
                 text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word): one row for each item that a document holds."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col(item_id).alias("item_id"), F.lower(F.col(item_text)).alias("body")).where("body is not null")
    docs = docs.select(F.col(id_column).alias("doc_id"), F.lower(F.col(text)).alias("body"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_bytes))
    item_kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {doc_kind}, item_id {item_kind}, edits int, item_words int, first_word long"

    def finder(sent):
        def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, ids = sent.value
            for part in parts:
                data, offsets = spans.text_bytes(part.column(1))
                for low, high in spans.chunks(offsets):
                    found = index.matches(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                    rows, numbers, edits, sizes, first = zip(*found) if found else ((),) * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(low, high - low).take(pa.array(rows, pa.int64())), ids.take(pa.array(numbers, pa.int64())),
                         pa.array(edits, pa.int32()), pa.array(sizes, pa.int32()), pa.array(first, pa.int64())],
                        names=["doc_id", "item_id", "edits", "item_words", "first_word"])

        return batches

    result = None
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == block).orderBy("item_id", "body").toArrow()
        index = Index(some["body"].to_pylist(), rate, repeats)
        sent = spark.sparkContext.broadcast((index, some["item_id"].combine_chunks()))
        part = docs.mapInArrow(finder(sent), layout)
        result = part if result is None else result.union(part)
    return result.withColumnsRenamed({"doc_id": id_column, "item_id": item_id})

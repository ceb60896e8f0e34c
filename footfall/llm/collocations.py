"""Phrase collocations, counted with HAT-tries.

Texts are split into pieces and words in Arrow batches. Each task counts the phrases of its part of the texts in a HAT-trie over the ids
that it gives to words (``hat_trie``); subtrees leave it as sorted runs, packed and dealt to prefix partitions: by language and the
first two words, so that a frequent first word does not send its phrases to one task. There are four partitions for each of the
session's shuffle partitions; what a task merges at once are the runs of one of them.

Longer phrases are counted only where they can be frequent. There are three passes: words; pairs whose two words are frequent; phrases of
three or more words all of whose pairs are frequent. A phrase as frequent as ``least`` has only parts that are as frequent, so nothing
is lost. What is frequent is marked in a field of ``BITS`` bits, the only thing that is broadcast, whatever the corpus; phrases
that share a marked bit are counted too and dropped by their exact count.

Candidates and their parts are ordinary tables then: cuts join the counts of both sides, words of longer candidates are looked up by
their phrases, and the first rows of each language come from a window that every task limits before the shuffle.

64-bit hashes tell words apart inside a task and choose bits; what is merged, joined and returned are the phrases themselves.

Defined cases: null text is empty; null language is ``und``, together with the rows of that language; repeated rows count repeatedly; ids
are not used. A text of more than ``spans.CHUNK`` bytes is cut between pieces; a piece is held whole. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm import spans
from footfall.llm.book import small_batches, stored
from footfall.llm.hat_trie import HatTrie, Run, packed, unpacked

LONGEST = 4
BITS = 1 << 26  # 8 MB
VOCABULARY = 1 << 20  # words that a task holds before it empties its trie
MERGED = 1 << 21  # rows of runs that wait to be merged
SCALE = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True


def sections(data: np.ndarray, offsets: np.ndarray, size: int = spans.CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that also cut long rows between pieces, and the row of each section."""
    cuts, rows = [offsets[:1]], []
    for row in range(len(offsets) - 1):
        low, high = int(offsets[row]), int(offsets[row + 1])
        ends = [high]
        if high - low > size:
            breaks = low + 1 + np.flatnonzero(_BREAK[data[low:high]])
            ends = np.unique(np.r_[breaks[np.searchsorted(breaks, np.arange(low + size, high, size), "left").clip(0, max(len(breaks) - 1, 0))]
                                   if len(breaks) else [], high]).astype(np.int64)
        cuts.append(np.asarray(ends))
        rows += [row] * len(ends)
    return np.concatenate(cuts), np.array(rows, np.int64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and piece of each word of lower-cased bytes; pieces are told apart, not numbered without gaps."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 4
    apart = _BREAK[data]
    inside = ~(apart | _BLANK[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, row, np.cumsum(apart)[starts] + row


def mixed(value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = (value ^ (value >> np.uint64(32))) * _STEP
        value = (value ^ (value >> np.uint64(29))) * _STEP
    return value ^ (value >> np.uint64(32))


def chained(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each phrase, from the hashes of its words."""
    out = hashes[0]
    with np.errstate(over="ignore"):
        for h in hashes[1:]:
            out = mixed(out * _STEP + h)
    return out


def language_hashes(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number of each row's language, the languages, and a hash of each."""
    column = column.fill_null("und").dictionary_encode()
    names = column.dictionary.to_pylist()
    return (column.indices.to_numpy(zero_copy_only=False).astype(np.int64), names,
            np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64))


class Vocabulary:
    """Ids of the words of each language that a task has met."""

    def __init__(self):
        self.ids: dict[int, int] = {}
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.hashes: list[int] = [0]

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, names: list[str],
               hashes: np.ndarray) -> np.ndarray:
        """The id of each word, from 1 on."""
        different, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.empty(len(different), np.int64)
        for k, (h, at) in enumerate(zip(different.tolist(), first.tolist())):
            known = self.ids.get(h)
            if known is None:
                known = self.ids[h] = len(self.words)
                self.words.append(data[starts[at]:ends[at]].tobytes())
                self.langs.append(names[lang[at]])
                self.hashes.append(h)
            found[k] = known
        return found[place]

    def runs(self, runs: list[Run], partitions: int) -> Iterator[pa.RecordBatch]:
        """(part, run): runs that left the trie, dealt to prefix partitions and packed; a run keeps the trie's order."""
        if not runs:
            return
        high, low, count = (np.concatenate(x) for x in zip(*runs))
        ids = unpacked(high, low)
        hashes = np.array(self.hashes, np.uint64)
        part = chained([hashes[ids[0]], hashes[ids[1]]]) % np.uint64(partitions)  # of the first two words
        order = np.lexsort((low, high, part))
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        taken = [words.take(pa.array(x[order])) for x in ids]
        phrase = pc.utf8_rtrim(pc.binary_join_element_wise(*taken, " "), " ")
        key = pc.binary_join_element_wise(pa.array(self.langs, pa.string()).take(pa.array(ids[0][order])), phrase, "\t")
        yield from packed_runs(key, count[order], part[order].astype(np.int64))


def packed_runs(key: pa.Array, count: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One compressed run for each partition of rows in order of partitions; a key is a language, a tab and a phrase."""
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(begin, np.r_[begin[1:], len(part)]):
        sink = pa.BufferOutputStream()
        rows = pa.record_batch([key[a:b], pa.array(count[a:b])], names=["key", "f"])
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                         names=["part", "run"])


def merged_runs(parts: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, f) of the keys that reach ``least``, and the totals, from runs in order of partitions."""
    waiting: list[pa.Table] = []
    last = None

    def added() -> pa.Table:
        return pa.concat_tables(waiting).group_by("key").aggregate([("f", "sum")]).rename_columns(["key", "f"])

    def done() -> Iterator[pa.RecordBatch]:
        if not waiting:
            return
        whole = added()
        whole = whole.filter(pc.or_(pc.greater_equal(whole["f"], least), pc.ends_with(whole["key"], "\t")))
        keys = [k.rpartition("\t") for k in whole["key"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[2].count(" ") + 1 if k[2] else 0 for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.string()), whole["f"].combine_chunks()], names=["lang", "words", "phrase", "f"])

    for some in parts:
        for part, run in zip(some.column(0).to_pylist(), some.column(1)):
            if part != last:
                yield from done()
                waiting, last = [], part
            waiting.append(pa.ipc.open_stream(run.as_buffer()).read_all())
            if len(waiting) > 1 and sum(t.num_rows for t in waiting) > MERGED + 2 * waiting[0].num_rows:
                waiting = [added()]
    yield from done()


class Counter:
    """Counts the phrases of the given lengths in one task; longer ones only where their parts are marked."""

    def __init__(self, lengths: tuple[int, ...], marks: np.ndarray | None, part: int):
        self.lengths, self.marks, self.part = lengths, marks, part
        self.words, self.trie, self.totals = Vocabulary(), HatTrie(), {}

    def add(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, names: list[str], salts: np.ndarray) -> Iterator[Run]:
        starts, ends, row, piece = words_of(data, offsets)
        own = lang[row]
        hashes = mixed(spans.xxh64(data, starts, ends) + salts[own]) if len(starts) else np.zeros(0, np.uint64)
        for k, n in enumerate(np.bincount(own, minlength=len(names)).tolist()):
            if n:
                self.totals[names[k]] = self.totals.get(names[k], 0) + n
        if self.marks is None:
            needed = np.ones(len(starts), bool)
        else:
            # Words in a marked part; other words need no id.
            last = max(0, len(starts) - self.part + 1)
            whole = piece[:last] == piece[self.part - 1:]
            marked = np.zeros(len(starts), bool)
            at = (chained([hashes[k:last + k] for k in range(self.part)]) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
            marked[:last] = whole & ((self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            needed = np.zeros(len(starts), bool)
            for k in range(self.part):
                needed[k:] |= marked[:len(marked) - k]
        ids = np.zeros(len(starts), np.int64)
        ids[needed] = self.words.number(data, starts[needed], ends[needed], own[needed], names, hashes[needed])
        for m in self.lengths:
            last = max(0, len(starts) - m + 1)
            good = piece[:last] == piece[m - 1:]
            if self.marks is not None:
                for k in range(m - self.part + 1):
                    good &= marked[k:last + k]
            begin = np.flatnonzero(good)
            yield from self.trie.add(*packed([ids[begin + k] for k in range(m)]))


def phrase_counts(docs: DataFrame, lengths: tuple[int, ...], least: int, marks=None, part: int = 0, lang: str = "lang",
                  text: str = "text") -> DataFrame:
    """(lang, words, phrase, f) of the phrases that occur ``least`` times; with words = 0, the number of words of a language.

    ``marks`` is a broadcast field of bits: only phrases all of whose parts of ``part`` words are marked are counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lengths, None if marks is None else marks.value, part)
        for some in parts:
            number, names, salts = language_hashes(some.column(0))
            data, offsets = spans.text_bytes(some.column(1))
            offsets, rows = sections(data, offsets)
            for low, high in spans.chunks(offsets):
                lower = spans.LOWER[data[offsets[low]:offsets[high]]]
                runs = list(counter.add(lower, offsets[low:high + 1] - offsets[low], number[rows[low:high]], names, salts))
                yield from counter.words.runs(runs, partitions)
                if len(counter.words.words) > VOCABULARY:
                    yield from counter.words.runs(list(counter.trie.spill()), partitions)
                    counter.words = Vocabulary()
        yield from counter.words.runs(list(counter.trie.spill()), partitions)
        if 1 in lengths and counter.totals:
            names = sorted(counter.totals, key=lambda x: xxhash.xxh64_intdigest(x) % partitions)
            yield from packed_runs(pa.array([f"{x}\t" for x in names], pa.string()), np.array([counter.totals[x] for x in names], np.int64),
                                   np.array([xxhash.xxh64_intdigest(x) % partitions for x in names], np.int64))

    def merge(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged_runs(parts, least)

    runs = docs.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(batches, "part int, run binary")
    return stored(runs.repartition("part").sortWithinPartitions("part").mapInArrow(
        merge, "lang string, words int, phrase string, f long"), "phrases")


def marked(phrases: DataFrame, part: int) -> np.ndarray:
    """A field of ``BITS`` bits with those of all phrases of (lang, phrase), each of ``part`` words."""

    def places(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in parts:
            number, _, salts = language_hashes(some.column(0))
            data, offsets = spans.text_bytes(some.column(1))
            starts, ends, row, _ = words_of(data, offsets)
            hashes = mixed(spans.xxh64(data, starts, ends) + salts[number[row]]).reshape(-1, part) if len(starts) else np.zeros((0, part), np.uint64)
            at = (chained(list(hashes.T)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(at & 63)], names=["cell", "bit"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "cell int, bit long")
    cells = found.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toArrow()  # at most BITS / 64 rows
    out = np.zeros(BITS >> 6, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words that occur ``least`` times, and of words = 0 the totals."""
    context = docs.sparkSession.sparkContext
    words = phrase_counts(docs, (1,), least, lang=lang, text=text)
    pairs = phrase_counts(docs, (2,), least, context.broadcast(marked(words.where("words = 1"), 1)), 1, lang, text)
    more = tuple(range(3, longest + 1))
    if not more:
        return words.unionByName(pairs)
    return words.unionByName(pairs).unionByName(phrase_counts(docs, more, least, context.broadcast(marked(pairs, 2)), 2, lang, text))


def _exact(number: int, column: Column) -> Column:
    """A product with a whole number below 10^8 that cannot overflow."""
    return F.lit(number).cast("decimal(8,0)") * column.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, most: int | None = 2000, inside: int = 80, longest: int = LONGEST, scale: int = SCALE,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language, or all.

    A candidate goes if its words lie inside a longer one that is ``inside`` per cent as frequent or more.
    """
    counts = frequent_phrases(docs, least, longest, lang, text)
    plain = counts.where("words > 0").select("lang", "phrase", "f")
    found = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("parts"))

    cut = found.select("lang", "phrase", "a", "parts", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("parts", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    left = plain.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = plain.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr(f"cast(cast(a as decimal(20,0)) * cast({scale} as decimal(8,0)) div cast(cast(l as decimal(20,0)) + r as decimal(21,0)) as long)")
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # The phrases inside each longer candidate: from word i, of m words.
    inner = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), "
                             "i -> array_join(slice(parts, i, m), ' '))))")).alias("phrase")
    longer = found.where("words > 2").select("lang", F.col("a").alias("whole"), inner).groupBy("lang", "phrase").agg(
        F.max("whole").alias("whole"))
    hidden = _exact(100, F.col("whole")) >= _exact(inside, F.col("a"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("whole").isNull() | ~hidden)

    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))

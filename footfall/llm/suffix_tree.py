"""Language-model scores from a probabilistic suffix tree, next to a word-unigram base score.

The tree reads small-letter words joined by single spaces, byte by byte, and one end symbol. Bytes are cut into 64 symbols:
the commonest bytes alone, the others together (with their own probabilities inside that symbol), start and end.
Contexts have up to ``DEPTH`` symbols. A context stays if its probability is at least ``least`` and its next-symbol
distribution diverges enough from its parent's: probability times relative entropy of at least ``gain``, and more bits saved
than its symbols cost to describe (half a log2 of the count each), which keeps chance contexts out. So at most
DEPTH / ``least`` contexts stay, however large the corpus is, and the tree can be broadcast. Distributions
are smoothed towards the longest remaining suffix's; a word's probability is the tree's for its bytes and what follows, mixed
evenly with the word's frequency (half a count for unknown ones), which the tree alone would have to learn letter by letter. For scoring the contexts become an automaton whose state is the longest
suffix of what was read that begins a context; many stretches of text run through it side by side, each warmed up by the
``DEPTH`` symbols before it.

Word counts cover all training documents. The ``COMMON`` most frequent words are broadcast; the counts of all others
are joined, so nothing that grows with the corpus is sent to every task.

Defined cases: null text is empty and has the end token only; a null id is a training row; repeated rows each count and
each get a row. Without training rows counts are zero and all symbols are alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import spans
from footfall.llm.book import small_batches, stored
from footfall.llm.labelled import held_out

DEPTH = 6
SYMBOLS, OTHER, START, END = 64, 61, 62, 63
LEAST = 5e-6
GAIN = 3e-7
SHARE = 0.5  # of the words' own frequencies in a word's probability
WEIGHT = 4.0  # of the shorter context's distribution in a longer one's
COMMON = 200_000
STRETCH = 512
MERGE = 1 << 21


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


class _Tally:
    """Counts of keys that are merged now and then and handed out as batches."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > MERGE:
            self.parts = [_merged(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size > MERGE // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = _merged(self.parts)
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), self.kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
                names=["kind", "key", "n"])


def _count(docs: DataFrame, kinds: int, count) -> DataFrame:
    """Sums of (kind, key, n) that ``count`` finds in chunks of texts."""

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [_Tally(k) for k in range(kinds)]
        for part in parts:
            data, offsets = spans.text_bytes(part.column(0))
            for low, high in spans.chunks(offsets):
                some = spans.LOWER[data[offsets[low]:offsets[high]]]
                for kind, keys, counts in count(*spans.spaced(some, offsets[low:high + 1] - offsets[low])):
                    yield from tallies[kind].add(keys, counts)
        for tally in tallies:
            yield from tally.rest()

    return docs.mapInArrow(batches, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _words_and_bytes(text, starts, ends, counts):
    yield 0, *np.unique(spans.xxh64(text, starts, ends), return_counts=True)
    seen = np.bincount(text, minlength=256)
    yield 1, np.flatnonzero(seen).astype(np.uint64), seen[seen > 0]
    yield 2, np.zeros(1, np.uint64), np.array([len(counts)])


class Alphabet:
    """Symbols of bytes, and the log10 probability of each byte inside its symbol."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(256), -counts))
        self.symbol = np.full(256, OTHER, np.uint8)
        self.symbol[order[:OTHER]] = np.arange(OTHER)
        rare = order[OTHER:]
        self.inside = np.zeros(256, np.float32)
        self.inside[rare] = np.log10((counts[rare] + 0.5) / (counts[rare].sum() + 0.5 * len(rare)))

    def stream(self, text: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all rows, ``DEPTH`` starts before each row and an end as its last; and for each byte of the text
        (words with one space after each) its log10 probability inside its symbol, 0 where the end takes its place."""
        size = _bytes(ends, counts)
        until = np.cumsum(np.maximum(size, 1) + DEPTH)
        out = np.full(int(until[-1]) if len(until) else 0, START, np.uint8)
        body = size > 0
        owner = spans.owners(size[body])
        inner = np.arange(len(text)) - (np.cumsum(size[body]) - size[body])[owner]
        out[(until - size)[body][owner] + inner] = self.symbol[text]
        out[until - 1] = END
        inside = self.inside[text].astype(np.float64)
        inside[np.cumsum(size[body]) - 1] = 0
        return out, inside


def _bytes(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of each row's words, with a space after each."""
    upto = np.concatenate([[0], ends + 1])[np.cumsum(counts)]
    return np.diff(upto, prepend=0)


def _blend(by_count: np.ndarray, by_tree: np.ndarray) -> np.ndarray:
    """log10 of the mixed probability."""
    return np.log10(SHARE * 10.0**by_count + (1 - SHARE) * 10.0**by_tree)


def grams(symbols: np.ndarray) -> np.ndarray:
    """For each symbol after the first ``DEPTH``: it and the ``DEPTH`` symbols before it, six bits each, newest lowest."""
    if len(symbols) <= DEPTH:
        return np.zeros(0, np.uint64)
    code = symbols[DEPTH:].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        code |= symbols[DEPTH - k:-k].astype(np.uint64) << np.uint64(6 * k)
    return code[symbols[DEPTH:] != START]


class Tree:
    """Retained contexts as an automaton with smoothed distributions."""

    def __init__(self, rows: Iterable[tuple[int, int, int, int]], weight: float = WEIGHT):
        """``rows``: (length, context code, symbol, count) of the retained contexts and the empty one."""
        table: dict[tuple[int, int], np.ndarray] = {}
        for d, context, symbol, n in rows:
            table.setdefault((d, context), np.zeros(SYMBOLS))[symbol] = n
        uniform = np.ones(SYMBOLS)
        uniform[START] = 0
        uniform /= uniform.sum()
        root = table.pop((0, 0), np.zeros(SYMBOLS))
        dense = [(root + 0.5 * uniform * (SYMBOLS - 1)) / (root.sum() + 0.5 * (SYMBOLS - 1))]
        children: list[dict[int, int]] = [{}]
        held = [0]  # the distribution of each node, -1: its suffix's
        for d, context in sorted(table):
            counts = table[d, context]
            suffix = next(((k, context % 64**k) for k in range(d - 1, 0, -1) if (k, context % 64**k) in table), None)
            base = dense[self._index[suffix]] if suffix else dense[0]
            dense.append((counts + weight * base) / (counts.sum() + weight))
            self._index[d, context] = len(dense) - 1
            node = 0
            for k in range(d - 1, -1, -1):  # oldest symbol first
                symbol = context >> (6 * k) & 63
                if symbol not in children[node]:
                    children[node][symbol] = len(children)
                    children.append({})
                    held.append(-1)
                node = children[node][symbol]
            held[node] = len(dense) - 1
        following = np.zeros((len(children), SYMBOLS), np.int32)
        suffix_of = np.zeros(len(children), np.int64)
        for symbol, child in children[0].items():
            following[0, symbol] = child
        level = [0]
        while level:
            ahead = []
            for node in level:
                if node:
                    if held[node] < 0:
                        held[node] = held[suffix_of[node]]
                    following[node] = following[suffix_of[node]]
                for symbol, child in children[node].items():
                    if node:
                        suffix_of[child] = following[suffix_of[node], symbol]
                    following[node, symbol] = child
                    ahead.append(child)
            level = ahead
        self.following = following.ravel()
        with np.errstate(divide="ignore"):
            logs = np.log10(np.stack(dense)).astype(np.float32)
        logs[:, START] = 0
        self.logs, self.held = logs.ravel(), np.array(held, np.int32) * SYMBOLS

    _index: dict

    def __new__(cls, *args, **kwargs):
        made = super().__new__(cls)
        made._index = {}
        return made

    def read(self, symbols: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol given what stands before it."""
        n = len(symbols)
        stretches = -(-n // STRETCH)
        padded = np.full(DEPTH + stretches * STRETCH, START, np.uint8)
        padded[DEPTH:DEPTH + n] = symbols
        begin = np.arange(stretches) * STRETCH
        state = np.zeros(stretches, np.int32)
        out = np.zeros((STRETCH, stretches), np.float32)
        for t in range(DEPTH + STRETCH):
            symbol = padded[begin + t]
            if t >= DEPTH:
                out[t - DEPTH] = self.logs[self.held[state] + symbol]
            state = self.following[state * SYMBOLS + symbol]
        return out.T.ravel()[:n]


def contexts(counted: DataFrame, total: int, least: float, gain: float) -> list[tuple[int, int, int, int]]:
    """(length, context, symbol, count) of the contexts that pass, and of the empty one."""
    code = F.col("key")
    levels = []
    for d in range(DEPTH + 1):
        context = F.shiftrightunsigned(code, 6).bitwiseAND(F.lit(64**d - 1).cast("long"))
        rows = counted.groupBy(context.alias("context"), code.bitwiseAND(F.lit(63).cast("long")).alias("symbol")).agg(
            F.sum("n").alias("n"))
        sizes = rows.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= max(1.0, least * total))
        levels.append(rows.join(sizes, "context").select(F.lit(d).alias("d"), "context", "symbol", "n", "all"))
    kept = levels[0]
    for level in levels[1:]:
        kept = kept.unionByName(level)
    kept = stored(kept, "contexts")
    parent = kept.select((F.col("d") + 1).alias("d"), F.col("context").alias("suffix"), "symbol",
                         (F.col("n") / F.col("all")).alias("q"))
    child = kept.where("d > 0").withColumn(
        "suffix", F.col("context").bitwiseAND(F.expr("shiftleft(1L, 6 * (d - 1)) - 1")))
    share = F.col("n") / F.col("all")
    apart = child.join(parent, ["d", "suffix", "symbol"]).groupBy("d", "context").agg(
        F.sum(F.col("n") * F.log2(share / F.col("q"))).alias("bits"), F.first("all").alias("all"), F.count("*").alias("symbols"))
    passed = apart.where((F.col("bits") >= gain * total) & (F.col("bits") >= F.col("symbols") * F.log2(F.col("all")) / 2)).select(
        "d", "context")
    rows = kept.where("d > 0").join(passed, ["d", "context"]).unionByName(kept.where("d = 0"), allowMissingColumns=True)
    got = rows.select("d", "context", "symbol", "n").toArrow()
    return list(zip(*(got[c].to_pylist() for c in ("d", "context", "symbol", "n"))))


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words above the least count, in steps of a 16th of a doubling, that at most ``most`` words reach."""
    step = F.floor(F.log2("n") * 16)
    number = 0
    for row in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # at most 1000 steps
        number += row["count"]
        if number > most:
            return words.where(step > row.step)
    return words


def score(docs: DataFrame, fold: int = 1, least: float = LEAST, gain: float = GAIN, common: int = COMMON,
          id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column, fold).alias("held_out"),
                       F.col(text).alias("text"))
    training = docs.where(~F.col("held_out")).select("text")

    words = stored(_count(training, 3, _words_and_bytes), "words")
    totals = {r.kind: r for r in words.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}
    rows = totals[2].n if 2 in totals else 0
    tokens = (totals[0].n if 0 in totals else 0) + rows
    types = (totals[0].types if 0 in totals else 0) + (rows > 0)
    byte_counts = np.zeros(256)
    for r in words.where("kind = 1").collect():
        byte_counts[r.key] = r.n
    alphabet = Alphabet(byte_counts)

    def symbol_grams(text, starts, ends, counts):
        code = grams(alphabet.stream(text, ends, counts)[0])
        yield 0, *np.unique(code, return_counts=True)

    counted = stored(_count(training, 1, symbol_grams), "grams")
    length = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    tree = Tree(contexts(counted, length, least, gain))

    often = _frequent(words.where("kind = 0"), common).select("key", "n").toArrow()
    keys = often["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((alphabet, tree, keys[order], often["n"].to_numpy()[order]))
    complete = types - (rows > 0) <= common  # all words are known to the tasks
    below = np.log10(tokens + 0.5 * (types + 1)) if tokens else np.log10(0.5)
    end_log = np.log10(rows + 0.5) - below
    go_on = np.log10(max(1 - 10**end_log, 1e-9))  # that a word is not the last

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, tree, known, known_counts = sent.value
        logs = np.append(np.log10(known_counts + 0.5), [0]) - below
        for part in parts:
            data, offsets = spans.text_bytes(part.column(2))
            for low, high in spans.chunks(offsets):
                some = spans.LOWER[data[offsets[low]:offsets[high]]]
                text, starts, ends, counts = spans.spaced(some, offsets[low:high + 1] - offsets[low])
                # The tree's probability of each word with the space or end after it.
                symbols, inside = alphabet.stream(text, ends, counts)
                logp = tree.read(symbols)[symbols != START].astype(np.float64)
                after = np.zeros(len(counts), np.int64)
                after[counts == 0] = 1
                places = np.cumsum(after + _bytes(ends, counts)) - 1  # of each row's end
                alone = np.zeros(len(logp), bool)
                alone[places[counts == 0]] = True
                empty = logp[alone]
                total = np.concatenate([[0.0], np.cumsum(logp[~alone] + inside)])
                by_tree = total[ends + 1] - total[starts]
                last = np.zeros(len(starts), bool)
                last[(np.cumsum(counts) - 1)[counts > 0]] = True

                types_here, back = np.unique(spans.xxh64(text, starts, ends), return_inverse=True)
                at = np.minimum(np.searchsorted(known, types_here), max(len(known) - 1, 0))
                hit = known[at] == types_here if len(known) else np.zeros(len(types_here), bool)
                values = np.where(hit, logs[np.where(hit, at, -1)], np.log10(0.5) - below)[back]
                found = hit[back]
                ready = found | complete
                score = np.where(ready, _blend(values + np.where(last, end_log, go_on), by_tree), 0.0)
                scores = spans.sums(score, counts)
                scores[counts == 0] = _blend(np.full(len(empty), end_log), empty)

                rare = np.flatnonzero(~ready)
                sizes = np.bincount(spans.owners(counts)[rare], minlength=high - low)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(types_here[back[rare]].view(np.int64)), pa.array(by_tree[rare].astype(np.float32)),
                                                pa.array(last[rare])], names=["key", "by_tree", "last"]))
                n = high - low
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(low, n), part.column(1).slice(low, n), pa.array(counts.astype(np.int64) + 1),
                     pa.array(spans.sums(found.astype(np.int64), counts) + int(rows > 0)),
                     pa.array(spans.sums(np.where(ready, values, 0.0), counts) + end_log), pa.array(scores), lists],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(batches, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, "
                                      "score double, rare array<struct<key:long,by_tree:float,last:boolean>>")
    if complete:
        result = scored.drop("rare")
    else:
        scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        rare = scored.select("row", F.inline("rare")).join(words.where("kind = 0").select("key", "n"), "key", "left")
        c = F.coalesce("n", F.lit(0))
        base = F.log10(c + 0.5) - F.lit(float(below))
        alike = F.lit(SHARE) * F.pow(F.lit(10.0), base + F.when(F.col("last"), float(end_log)).otherwise(float(go_on)))
        blend = F.log10(alike + (1 - SHARE) * F.pow(F.lit(10.0), F.col("by_tree").cast("double")))
        more = rare.groupBy("row").agg(F.sum(base).alias("more_base"), F.sum(blend).alias("more_score"),
                                       F.sum(F.when(c > 0, 1).otherwise(0)).alias("more_known"))
        result = scored.drop("rare").join(more, "row", "left").withColumns({
            "base_score": F.col("base_score") + F.coalesce("more_base", F.lit(0.0)),
            "score": F.col("score") + F.coalesce("more_score", F.lit(0.0)),
            "n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0))})
    return result.select(F.col("doc_id").alias(id_column), "held_out", "n_tokens", "n_known",
                         F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")

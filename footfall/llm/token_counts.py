"""Token counts through a digest cache.

A count is stored under the digest of the (normalised) text and the digest of the tokenizer's file. Texts whose digest
is in the cache are not encoded; of the others each different text is encoded once, and its count is appended. Inside
a task, a text is cut before each space that follows an ASCII byte other than white space (after other bytes the character may be
Unicode white space, which the tokenizer takes together with the space). A byte-level BPE tokenizer splits there before it merges, so the counts of the pieces add up to the count of the text, and each different piece is given
to the library once per batch of pieces.

Defined cases: null text is empty and has 0 tokens; repeated rows each get a row. A cache that two jobs appended to at
once may hold a digest twice with one count; it is read once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall import session
from footfall.llm import spans
from footfall.llm.book import small_batches, stored

CACHE = "content string, tokenizer string, n_tokens long"
MEMO = 1_000_000  # pieces a task remembers; then it starts anew


def _additive(path: str) -> bool:
    """Whether the counts of the pieces add up: byte-level splitting that adds no space of its own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    added = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    return bool(plain and added and not spec.get("normalizer") and spec["model"].get("type") == "BPE")


class Counter:
    """Counts tokens of many texts at once, remembering the counts of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)]
            self._whole = True
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self._lengths = lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            self._whole = not _additive(path)
        self._known = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a byte array."""
        if self._whole:
            raw = data.tobytes()
            return np.array(self._lengths([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]), np.int64)
        parts = [self._chunk(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in spans.chunks(offsets)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 0x20) & ~spans.SPACE[data[:-1]] & (data[:-1] < 0x80)
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        keys, first, back = np.unique(spans.xxh64(data, starts, ends), return_index=True, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        known, values = self._known
        at = np.searchsorted(known, keys)
        hit = np.zeros(len(keys), bool)
        if len(known):
            hit = known[np.minimum(at, len(known) - 1)] == keys
            counts[hit] = values[at[hit]]
        raw = data.tobytes()
        fresh = np.flatnonzero(~hit)
        for k in range(0, len(fresh), 20_000):
            some = fresh[k:k + 20_000]
            counts[some] = self._lengths([raw[starts[i]:ends[i]].decode() for i in first[some]])
        if len(known) + len(fresh) > MEMO:
            known, values, fresh = known[:0], values[:0], np.arange(len(keys))
        merged = np.concatenate([known, keys[fresh]])
        order = np.argsort(merged)
        self._known = merged[order], np.concatenate([values, counts[fresh]])[order]
        return spans.sums(counts[back], np.diff(np.searchsorted(starts, offsets)))


def version(path: str) -> str:
    """Digest of the tokenizer's file and library."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none if it doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(T._parse_datatype_string(CACHE)).parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row. ``path`` is the tokenizer's file, the same on every machine or
    found there by its name after ``SparkContext.addFile``; ``cache`` a folder in a shared store."""
    spark = docs.sparkSession
    small_batches(spark)
    cache = cache or session.scratch(spark, "token-counts")
    now = version(path)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(id_column).alias("doc_id"), body.alias("body"), F.octet_length(body).cast("long").alias("n_bytes"),
                       F.sha2(body.cast("binary"), 256).alias("content"))
    mine = read_cache(spark, cache).where(F.col("tokenizer") == now).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # Copies meet in the map tasks first, so a text with a third of all rows is shuffled once per task.
    misses = docs.groupBy("content").agg(F.first("body").alias("body")).join(mine, "content", "left_anti")

    def encode(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        for part in parts:
            data, offsets = spans.text_bytes(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([now] * part.num_rows, pa.string()), pa.array(counter(data, offsets))],
                names=["content", "tokenizer", "n_tokens"])

    misses.select("content", "body").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    # Written out, so that the join below has plain shuffles on both sides and adaptive execution can split a hot text's.
    counts = stored(read_cache(spark, cache).where(F.col("tokenizer") == now).groupBy("content").agg(
        F.max("n_tokens").alias("n_tokens")), "counts")
    return docs.select("doc_id", "n_bytes", "content").join(counts, "content").select(
        F.col("doc_id").alias(id_column), "n_bytes", "n_tokens")

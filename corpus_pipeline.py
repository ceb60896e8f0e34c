"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Toxic documents go; of each group of near copies the one with the smallest id stays; bytes of passages that occur more than
once (400 bytes, or more than 50 words) go from the texts, and documents of which nothing is left; documents that hold a benchmark item go; the rest is mixed
to target weights. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import decontamination, mixing, passages, simhash, spans, toxicity
from footfall.llm.book import small_batches, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels, scores below one half."""
    small_batches(spark)
    net = spark.sparkContext.broadcast(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def keep(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(net.value.probability(*spans.text_bytes(part.column(at))) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more): the smallest id.

    A null id counts as the largest; rows with one id and text are one document.
    """
    columns = docs.columns
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__k1"),
                   F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__k2"))
    pair = ["__k1", "__k2"]
    keyed = docs.withColumn("__key", key)
    groups = simhash.near_duplicates(keyed, size=5, similarity=0.8, id_column="__key")
    kept = stored(groups.where(F.col("__key") == F.col("component_id")).groupBy(*[F.col(f"__key.{c}") for c in pair]).agg(F.count("*").alias("__n")), "kept")
    rows = keyed.select(*columns, "__key.*").join(kept, pair)
    # Rows with the id and text of another are rare; only they meet to leave one.
    twice = rows.where("__n > 1").dropDuplicates(pair)
    return rows.where("__n = 1").select(*columns).unionByName(twice.select(*columns))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages: of 400 bytes as in op10, or of more than 50 words.

    Documents of which no word is left go, others keep their columns.
    """
    small_batches(spark, size="4m")  # words and their hashes take many times the bytes of a text
    columns = docs.columns
    rest = F.struct(*[c for c in columns if c != "text"]).alias("rest")
    keyed = passages.keyed(docs.select("doc_id", "text", rest), "doc_id", "text").withColumn(
        "missing", F.col("text").isNull()).select("rest", "missing", "body", "id1", "id2")
    found = passages.repeated_stretches(keyed).withColumn("words", F.lit(False)).unionByName(
        passages.repeated_words(keyed).withColumn("words", F.lit(True)))
    # Repeated rows (one id, one text) have the same stretches, which are listed once.
    stretches = found.groupBy("id1", "id2").agg(F.collect_set(F.struct("begin", "end", "words")).alias("spans"))
    joined = keyed.join(stretches.hint("shuffle_hash"), ["id1", "id2"], "left").select("rest", "missing", "body", "spans")

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = list(passages.cut_rows(part.column(2), passages.in_bytes(part.column(2), part.column(3))))
            texts = pa.array([left.decode("utf-8", "ignore") for left, *_ in rows], pa.string())
            keep = pa.array([not gone or bool(left.strip()) for left, _, gone, _ in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["rest", "missing", "text"]).filter(keep)

    kind = keyed.schema["rest"].dataType.simpleString()
    done = joined.mapInArrow(cut, f"rest {kind}, missing boolean, text string").withColumn("text", F.expr("if(missing, null, text)"))
    size = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in columns else None
    return done.select(*[F.col("text") if c == "text" else size if c == "n_chars" else F.col(f"rest.{c}") for c in columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    columns = docs.columns
    pages = docs.withColumn("__row", F.struct(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark")))
    found = decontamination.contaminated(pages, table(spark, sf_dir, "benchmark"), id_column="__row")
    leaks = stored(found.select("__row.*").distinct(), "leaks").withColumnRenamed("doc_id", "leak_id")
    same = pages["doc_id"].eqNullSafe(leaks["leak_id"]) & (pages["__row.mark"] == leaks["mark"])
    return pages.join(leaks, same, "left_anti").select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes: their columns, size, source_size, target and taken words."""
    mix = mixing.mix(docs, WEIGHTS, BUDGET, MOST, quality=mixing.variety("text"), keep=[c for c in docs.columns if c not in (
        "doc_id", "source", "size", "source_size", "target", "taken")])
    return mix.where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Learned weights, graph components and exact byte runs cannot be written as SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result, starting from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

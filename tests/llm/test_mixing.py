"""Mixing against a direct reading of its definition."""

import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from footfall.llm import mixing

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted([n for n in sizes if n is not None]) + ([None] if None in sizes else [])
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    target, left, free = {}, budget * sum(sizes.values()), set(names)
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n]]
        for n in over or free:
            target[n] = most * sizes[n] if over else share[n]
        if not over:
            break
        left -= sum(target[n] for n in over)
        free -= set(over)
    return target


def check(rows, got, exact=True):
    sizes, sources = {}, {}
    for k, text, source in rows:
        sizes[k], sources[k] = len(WORD.findall(text or "")), source
    total = {}
    for k, s in sources.items():
        total[s] = total.get(s, 0) + sizes[k]
    target = shared(total)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.size == sizes[r.doc_id] and r.source_size == total[sources[r.doc_id]]
        assert math.isclose(r.target, target[sources[r.doc_id]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[sources[r.doc_id]] = taken.get(sources[r.doc_id], 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    run = entries.queries()["op3_mixing"]
    got = run(spark, DATA).collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    assert sorted(got) == sorted(run(spark, DATA).collect())
    assert dict(run(spark, DATA).dtypes) == {
        "doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}


def test_keys_decide(spark):
    """Within the fractional part a document is taken only if all with smaller keys are."""
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "s") for k in range(500)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, (1,), 0.5).collect()}
    slim = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.lit(1.0).alias("quality"))
    keys = {r.doc_id: r.key for r in slim.withColumn("key", mixing._key(0)).collect()}
    order = sorted(keys, key=keys.get)
    parts = [got[k].taken / got[k].size for k in order]
    assert parts == sorted(parts, reverse=True) and sum(0 < p < 1 for p in parts) <= 1


def test_better_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"),
                                    F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("q"))
    got = mixing.mix(docs, (1,), 0.25, quality=F.col("q")).groupBy((F.col("doc_id") % 2).alias("odd")).agg(
        F.sum("taken").alias("t")).collect()
    t = {r.odd: r.t for r in got}
    assert t[0] > 1.8 * t[1]


@pytest.mark.parametrize("rows", [
    [(1, None, None), (2, "", "a"), (3, "x y", None), (4, "x", "b"), (5, "q " * 50_000, "c"), (6, "é é", "B"), (7, " ", "")],
    [(1, None, "a")],
    [(k, "same words here", "hot" if k % 3 else None) for k in range(300)],
])
def test_edges(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int")
    check(rows, mixing.mix(df, (3, 1, 2)).collect())
    assert mixing.mix(df.limit(0), (3, 1, 2)).count() == 0

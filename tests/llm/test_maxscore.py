"""Exact top-k against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from footfall.llm import maxscore
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.001"


def direct(rows, scale=1024, step=100, k=10):
    usable = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i % step == 0:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for q, v in queries.items():
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -2**63), 2**63 - 1), i) for i, w in usable if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, rank int")
    vectors = maxscore.whole_vectors(df.repartition(3), "vec_id", "embedding", 1024)
    return {tuple(r) for r in maxscore.top_k(vectors, F.col("vec_id") % 100 == 0, **options).collect()}


def single(rows):
    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_query(spark):
    df = entries.queries()["op9_maxscore"](spark, DATA)
    assert difference(df, connection(DATA), entries.oracle_sql()["op9_maxscore"]) == ""


@pytest.mark.parametrize("kind", ["random", "ties", "few", "large", "huge", "some"])
def test_direct(spark, kind):
    rnd = random.Random(4)
    value = {"random": lambda: rnd.gauss(0, 1), "ties": lambda: rnd.choice([-1.0, 0.0, 0.5]), "few": lambda: rnd.random(),
             "large": lambda: rnd.gauss(0, 1) * 1e5, "huge": lambda: rnd.gauss(0, 1) * 10.0**rnd.randrange(12),
             "some": lambda: rnd.choice([1.0, 2e6, -2e6, 3e20]) if rnd.random() < 0.01 else rnd.gauss(0, 1)}[kind]
    n = 7 if kind == "few" else 900
    rows = [(k, [value() for _ in range(20)]) for k in range(n)]
    rows += [(None, [1.0] * 20), (1000, None), (1100, [None] + [1.0] * 19), (1200, [math.nan] * 20), (1300, [math.inf] * 20),
             (1400, []), (1500, [9.0]), (5, rows[5][1]), (0, rows[0][1]), (1600, [0.0] * 20), (1700, [1.0] * 33)]
    rows = single(rows)
    assert result(spark, rows, block=3, rows_at_once=200, shard=64) == direct(rows)


def test_empty(spark):
    assert result(spark, []) == set()
    assert result(spark, [(0, [1.0])]) == set()
    assert result(spark, [(1, [1.0])]) == set()


def test_large_component(spark, tmp_path):
    rows = [(k, [float(k % 7), 1.0, -2.0]) for k in range(300)] + [(301, [2e6, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = entries.queries()["op9_maxscore"](spark, str(tmp_path))
    assert df.where("vec_id = 301").count() == 2  # queries 100 and 200; 0 is at right angles to it
    for row in df.where("query_id = 100 and rank = 1").collect():
        assert (row.vec_id, row.score) == (301, 2 * 1024 * 2_048_000_000)


def test_plan_is_the_same_for_any_number_of_queries(spark):
    rows = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(500)], "vec_id long, embedding array<float>")
    vectors = maxscore.whole_vectors(rows, "vec_id", "embedding", 1024)
    plans = [maxscore.top_k(vectors, F.col("vec_id") % step == 0, block=10)._jdf.queryExecution().optimizedPlan().toString()
             for step in (100, 2)]
    assert len({p.count("\n") for p in plans}) == 1


def test_weak_terms_are_not_probed_for_all():
    rnd = np.random.default_rng(0)
    vectors = rnd.integers(-3, 4, (2000, 30))
    vectors[:, :3] *= 500
    query = np.ones((1, 30), np.int64)
    (_, ids, scores), = maxscore.search_shard(query, np.array([-1]), vectors, np.arange(2000), 10)
    exact = vectors.sum(axis=1)
    order = np.lexsort((np.arange(2000), -exact))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()

"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from footfall.llm import hard_negatives
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.001"


def direct(rows, scale=256, step=100, positives=5, negatives=10, low=30, high=90):
    usable = [(i, c, [math.floor(scale * float(x)) for x in v]) for i, v, c in rows
              if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, c, v in usable:
        if i % step == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (label, v) in anchors.items():
        scores = [(max(min(sum(x * y for x, y in zip(v, w)), 2**63 - 1), -2**63), i, c) for i, c, w in usable if i != a]
        best = sorted((-s, i) for s, i, c in scores if c == label)[:positives]
        for p, i in best:
            p = -p
            fits = sorted((-s, j) for s, j, c in scores if c != label and low * p <= 100 * s <= high * p)[:negatives]
            out += [(a, i, n + 1, j, p, -s) for n, (s, j) in enumerate(fits)]
    return sorted(out)


def result(spark, rows, **options):
    rows = [(*r, 1, 2) for r in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, g int")
    vectors = hard_negatives.whole_vectors(df.repartition(3), "vec_id", "embedding", "label", 256)
    return sorted(tuple(r) for r in hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, **options).collect())


def single(rows):
    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]


def test_query(spark):
    df = entries.queries()["op12_hard_negatives"](spark, DATA)
    assert difference(df, connection(DATA), entries.oracle_sql()["op12_hard_negatives"]) == ""
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


@pytest.mark.parametrize("kind", ["random", "ties", "zero", "large", "huge"])
def test_direct(spark, kind):
    rnd = random.Random(5)
    value = {"random": lambda: rnd.gauss(0.4, 1), "ties": lambda: rnd.choice([-1.0, 0.0, 0.5]), "zero": lambda: rnd.choice([0.0, 0.0, 0.01]),
             "large": lambda: rnd.gauss(1, 1) * 1e5, "huge": lambda: rnd.gauss(1, 1) * 10.0 ** rnd.randint(0, 12)}[kind]
    rows = [(k, [value() for _ in range(12)], rnd.randint(0, 4)) for k in range(600)]
    rows += [(None, [1.0] * 12, 1), (1000, None, 1), (1100, [None] + [1.0] * 11, 1), (1200, [math.nan] * 12, 2), (1300, [math.inf] * 12, 2),
             (1400, [], 1), (1500, [9.0], 0), (1600, [0.0] * 12, 1), (1700, [1.0] * 20, 3), (1800, [1.0] * 12, None), (2000, [1.0] * 12, 77)]
    rows += [(5, *rows[5][1:])] * 30 + [(0, *rows[0][1:])] * 30 + [(100, [2.0] * 12, 4), (3, [0.5] * 12, 2)]
    rows = single(rows)
    assert result(spark, rows, rows_at_once=97, anchors_at_once=3) == direct(rows)
    assert result(spark, rows) == direct(rows)
    assert result(spark, rows, positives=2, negatives=3, low=0, high=100) == direct(rows, positives=2, negatives=3, low=0, high=100)


def test_hot_label_and_vector(spark):
    rows = single([(k, [1.0, 0.5 if k % 3 else k / 1000], int(k % 3 == 0)) for k in range(1500)])
    assert result(spark, rows, rows_at_once=200) == direct(rows)


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0], 1)]) == []
    assert result(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []


def test_bounds():
    for p in range(-20, 21):
        least, most = hard_negatives.bounds(p, 30, 90)
        assert {n for n in range(-40, 41) if 30 * p <= 100 * n <= 90 * p} == set(range(least, most + 1))


def test_exact_products():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**40, -1.0], [-(2.0**40), 0.0]])
    assert hard_negatives.inner_products(a, b).tolist() == [[2**60 + 1, 2**63 - 1, -2**63]]

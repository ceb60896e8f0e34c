"""Language-model scores: the base by hand, the tree against longest suffixes looked up one by one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entries
from footfall.llm import spans, suffix_tree

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def check(rows, got):
    counts = Counter()
    for k, text in rows:
        if not held_out(k):
            counts.update([*words(text), None])
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for k, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (types + 1))) for t in tokens)
        want[k, held_out(k), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("common", [200_000, 40])
def test_whole_table(spark, common):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = (suffix_tree.score(docs, common=common) if common == 40 else entries.queries()["op8_suffix_tree"](spark, DATA)).collect()
    check(rows, got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edges(spark):
    rows = [(k, f"common words {k % 7} and more words") for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "é " * 50_000), (104, "w" * 200_000), (None, "no id"), (5, "common"), (5, "common")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, n_tokens int, score double")
    first, second = suffix_tree.score(df).collect(), suffix_tree.score(df, common=3).collect()
    check(rows, first)
    check(rows, second)  # rare words are joined
    assert np.allclose(sorted(r.score for r in first), sorted(r.score for r in second), rtol=1e-5)
    assert suffix_tree.score(df.limit(0)).count() == 0
    held = [(k, "only held out") for k in range(200) if held_out(k)]
    check(held, suffix_tree.score(spark.createDataFrame(held, "doc_id long, text string")).collect())


def test_longest_suffix_states():
    rnd = random.Random(2)
    table = {}
    for d in range(1, 5):
        for _ in range(40):
            context = 0
            for _ in range(d):
                context = context << 6 | rnd.randrange(3)
            table[d, context] = {s: rnd.randrange(1, 30) for s in range(3)}
    root = {s: 50 + s for s in range(5)}
    rows = [(0, 0, s, n) for s, n in root.items()] + [(d, c, s, n) for (d, c), x in table.items() for s, n in x.items()]
    tree = suffix_tree.Tree(rows)
    symbols = np.array([suffix_tree.START] * 6 + [rnd.randrange(4) for _ in range(3000)] + [suffix_tree.END], np.uint8)
    got = tree.read(symbols)

    def distribution(d, context):
        if not d:
            n = np.array([root.get(s, 0) for s in range(64)], float)
            flat = np.ones(64)
            flat[suffix_tree.START] = 0
            return (n + 0.5 * flat) / (n.sum() + 0.5 * 63)
        own = table.get((d, context))
        shorter = distribution(d - 1, context % 64 ** (d - 1))
        if own is None:
            return shorter
        n = np.array([own.get(s, 0) for s in range(64)], float)
        return (n + suffix_tree.WEIGHT * shorter) / (n.sum() + suffix_tree.WEIGHT)

    for k in range(6, len(symbols)):
        context = 0
        for s in symbols[k - 6:k]:
            context = context << 6 | int(s)
        assert abs(math.log10(distribution(6, context)[symbols[k]]) - got[k]) < 1e-5
    assert abs(distribution(4, next(c for d, c in table if d == 4)).sum() - 1) < 1e-9


def test_grams_and_streams():
    data, offsets = spans.text_bytes(__import__("pyarrow").array(["ab a", "", "b"]))
    text, starts, ends, counts = spans.spaced(data, offsets)
    alphabet = suffix_tree.Alphabet(np.bincount(text, minlength=256).astype(float))
    symbols, inside = alphabet.stream(text, ends, counts)
    a, b, space = (int(alphabet.symbol[ord(c)]) for c in "ab ")
    s, e = suffix_tree.START, suffix_tree.END
    assert symbols.tolist() == [s] * 6 + [a, b, space, a, e] + [s] * 6 + [e] + [s] * 6 + [b, e]
    assert len(inside) == len(text) == 7
    codes = suffix_tree.grams(symbols).tolist()
    assert len(codes) == 8 and codes[1] & 63 == b and codes[1] >> 6 & 63 == a and codes[1] >> 12 & 63 == s

"""SimHash components against all pairs."""

import random
import re

import xxhash

import __spark_entry__ as entries
from footfall.llm import simhash
from footfall.llm.components import components

DATA = "/root/testdata/sf0.001"


def fingerprint(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", low)
    parts = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def direct(rows):
    prints = {k: fingerprint(t) for k, t in rows}
    ids = sorted(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = joined(pairs, ids)
    return {k: (f"{prints[k]:016x}", root[k]) for k in ids}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert result(entries.queries()["op7_simhash"](spark, DATA)) == direct(rows)


def test_edge_texts(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n", "one", "One", "one two", "one  TWO\tthree", "é " * 40_000, "w" * 300_000, "a b c", "a b c"]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    rows = [(k + 3, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, component_id int")
    assert result(simhash.near_duplicates(df)) == direct(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(None, "a"), (4, "a"), (4, "a")], "doc_id long, text string")
                                   ).select("component_id").collect() == [(4,)] * 3


def test_links_in_crowded_and_small_buckets(spark):
    rnd = random.Random(3)
    fps = {0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 1}
    while len(fps) < 500:
        fps.add(rnd.choice(sorted(fps)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    far = [rnd.getrandbits(64) for _ in range(200)]
    nodes = sorted(f - (1 << 64) if f >> 63 else f for f in fps | set(far))
    df = spark.createDataFrame([(f,) for f in nodes], "fp long")
    near = [(a, b) for n, a in enumerate(nodes) for b in nodes[n + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    for bucket in (4, 10_000):
        got = [(r.a, r.b) for r in simhash.links(df, bucket).collect()]
        assert {(min(p), max(p)) for p in got} <= set(near)
        assert joined(got, nodes) == joined(near, nodes)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + rnd.randrange(90), 1000 + rnd.randrange(90)) for _ in range(60)]
    edges += [(5000, 5001 + k) for k in range(200)] + [(7, 7)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {n: r for n, r in joined(edges, {n for e in edges for n in e}).items() if n in nodes}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0

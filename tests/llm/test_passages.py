"""Repeated passages against every string of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entries
from footfall.llm import passages

DATA = "/root/testdata/sf0.001"
N = passages.LENGTH


def direct(texts):
    """Bytes, removed bytes, runs and digest of what is left, of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + N] for b in raw for k in range(len(b) - N + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - N + 1):
            if seen[b[k:k + N]] > 1:
                gone[k:k + N] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = sorted((r.doc_id, *d) for r, d in zip(rows, direct([r.text for r in rows])))
    got = result(entries.queries()["op10_passages"](spark, DATA))
    assert got == want and sum(w[2] for w in want) > 0


def made():
    rnd = random.Random(8)

    def noise(n):
        return "".join(rnd.choice("abcdefgh é") for _ in range(n))

    common, second = noise(900), noise(399)
    texts = [None, "", "short", noise(395), "a" * 401, "b" * 399, "cd" * 300, noise(50) * 20]
    texts += [noise(rnd.randint(0, 300)) + common + noise(rnd.randint(0, 300)) for _ in range(12)]
    texts += [noise(100) + common[a:a + n] + noise(90) for a, n in ((0, 399), (0, 400), (300, 401), (499, 401), (17, 700))]
    texts += [noise(20) + second + "x" + noise(30), noise(10) + second + "x" + noise(9), second, second]
    base = noise(3000)
    for k in (0, 410, 800, 1500, 2999):
        texts.append(base[:k] + "#" + base[k + 1:])
    texts += [base + base[:500], texts[9], texts[9]]
    return texts


@pytest.mark.parametrize("group, piece, parts", [(2000, 1 << 20, 1), (2000, 500, 7), (1, 1 << 20, 3)])
def test_made_texts(spark, group, piece, parts):
    """Also with every group string by string, with short pieces and many buckets."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = made()
        df = spark.createDataFrame([(k, t, 0, "z") for k, t in enumerate(texts)], "doc_id long, text string, id1 int, kept string")
        assert result(passages.remove_repeated(df.repartition(3), group=group, piece=piece)) == sorted(
            (k, *d) for k, d in enumerate(direct(texts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_groups_split_over_buckets(spark):
    """One opening before many continuations: groups with one lead and hashes of both signs, each split over two buckets."""
    def suffix(f, h, row):
        return (b"o" * passages.LEAD, f, h, row, row, 0, 1)

    rows = [suffix(f, 5, k) for k, f in enumerate([-9, -7, -7, -5, 3, 3, 8])]
    kind = "lead binary, f long, h long, id1 long, id2 long, first long, size int"
    # Bucket 1 ends inside the group -7, bucket 2 inside the group 3.
    buckets = [rows[:2], rows[2:5], rows[5:]]

    class Dealt:
        def repartitionByRange(self, *_):
            return spark.createDataFrame(spark.sparkContext.parallelize(range(3), 3).flatMap(lambda k: buckets[k]), kind)

    found = passages._settled(passages._compared(Dealt())).where(f"kind = {passages.REPEATED}").collect()
    assert sorted(r.id1 for r in found) == [1, 2, 4, 5]


def test_same_ids_and_empty(spark):
    text = "".join(random.Random(1).choice("abc ") for _ in range(600))
    df = spark.createDataFrame([(None, text), (None, text), (1, "x"), (1, text + "y")], "doc_id long, text string")
    got = passages.remove_repeated(df).select("n_removed", "kept").collect()
    assert sorted(tuple(r) for r in got) == [(0, "x"), (600, ""), (600, ""), (600, "y")]
    assert passages.remove_repeated(df.limit(0)).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 5, 20_000).astype(np.uint64) for _ in range(4)]
    order = passages.multikey_quicksort(columns)
    rows = np.stack(columns, axis=1)
    assert sorted(order.tolist()) == list(range(20_000))
    assert rows[order].tolist() == sorted(rows.tolist())


def test_words_in_repeated_runs(spark):
    """Against every run of 51 words of every text; bytes are removed as without the count."""
    rnd = random.Random(4)

    def noise(n):
        return [rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(99)) for _ in range(n)]

    common, run = noise(60), passages.WORDS
    texts = [None, "", " ".join(noise(40)), " ".join(noise(70) + common), "\n".join(common[:51] + noise(30)), " ".join(common[5:55]),
             " ".join(noise(9) + common[:52] + noise(4) + common[:52]), " ".join(["x"] * 80)]
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[k:k + run]) for w in split for k in range(len(w) - run + 1))
    want = [len({k + j for k in range(len(w) - run + 1) if seen[tuple(w[k:k + run])] > 1 for j in range(run)}) for w in split]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = passages.remove_repeated(df, words=run)
    assert {r.doc_id: r.n_run_words for r in got.collect()} == dict(enumerate(want)) and sum(w > 0 for w in want) == 4
    assert result(got) == sorted((k, *d) for k, d in enumerate(direct(texts)))


def test_repeated_rows_cost_in_proportion(spark):
    """5000 rows with one id and text: their stretches are listed once."""
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(1500))
    df = spark.createDataFrame([(1, text)] * 5000 + [(2, "other")], "doc_id long, text string").repartition(4)
    got = passages.remove_repeated(df).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1500, 5000), (2, 0, 1)]


def test_short_texts_are_hashed_together(monkeypatch):
    """Texts that share a part give the runs that each gives alone, with far fewer parts than texts."""
    rnd = random.Random(3)
    texts = ["a" * N, "", "a" * (N + 9), "short", "ab" * N, "a" * (N - 1), "b" * N] + [
        "".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 1500))) for _ in range(300)] + ["xyz" * 30000, "z" * N]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw])
    made = []
    monkeypatch.setattr(passages, "Hashes", lambda text, hashes=passages.Hashes: made.append(len(text)) or hashes(text))

    def runs(data, offsets, size):
        found = []
        for bounds, rows, begins in passages.pieces(offsets, size):
            text, bounds = data[bounds[0]:bounds[-1]], bounds - bounds[0]
            if len(text) < N:
                continue
            hashes = passages.Hashes(text)
            at, first, starts = passages.anchors(text, bounds, hashes)
            k = np.searchsorted(bounds, first, "right") - 1
            shift = begins[k] - bounds[k]
            shared = hashes.of(at, at + N - passages.span(N))
            found += zip(rows[k].tolist(), (at + shift).tolist(), (first + shift).tolist(), starts.tolist(), shared.tolist())
        return found

    for size in (passages.PIECE, 700):
        alone = [(r, *run[1:]) for r, b in enumerate(raw)
                 for run in runs(np.frombuffer(b, np.uint8), np.array([0, len(b)]), size)]
        made.clear()
        assert runs(data, offsets, size) == alone
        assert sum(starts for _, _, _, starts, _ in alone) == sum(max(0, len(b) - N + 1) for b in raw)
        if size == passages.PIECE:
            assert len(made) < 20

    whole = [b for b in raw if len(b) >= N]
    bounds = np.cumsum([0] + [len(b) for b in whole])
    each = [passages._string_hashes(np.frombuffer(b, np.uint8), np.array([0, len(b)]), N) for b in whole]
    made.clear()
    assert (passages._string_hashes(np.frombuffer(b"".join(whole), np.uint8), bounds, N) == np.concatenate(each)).all()
    assert len(made) < 20

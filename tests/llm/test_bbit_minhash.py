"""Near-duplicates by b-bit MinHash against all pairs."""

import random
import re

import numpy as np
import pytest

import __spark_entry__ as entries
from footfall.llm import bbit_minhash as op
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def direct(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    own = [least.get(find(k)) if sets[k] else rows[k][0] for k in range(len(rows))]
    return sorted(((doc, len(sets[k]), own[k], doc == own[k]) for k, (doc, _) in enumerate(rows)), key=repr)


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, fid string, key int").repartition(3)
    return sorted((tuple(r) for r in op.near_duplicates(df, **options).collect()), key=repr)


def copies(rnd, words, number, edits):
    out = []
    for _ in range(number):
        some = list(words)
        for _ in range(edits):
            some[rnd.randrange(len(some))] = f"z{rnd.randrange(10**6)}"
        out.append(" ".join(some))
    return out


def collection(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 10, 80, 200]))) for _ in range(150)]
    for _ in range(40):  # from equal to far below the bound
        texts += copies(rnd, rnd.choices(vocabulary, k=rnd.choice([60, 150, 400])), 3, rnd.randint(0, 8))
    texts += copies(rnd, rnd.choices(vocabulary, k=300), 120, 4)  # a large group, some pairs of which are no links
    texts += copies(rnd, rnd.choices(vocabulary, k=300), 60, 9)  # members near each other, most of them below the bound
    texts += [texts[0]] * 50 + [None, "", " \t\n", None, "A b", "a  B", "a b c", "a", "b", "A B C"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows + [(None, texts[3]), (None, "only here so far"), (7, "another text of seven"), rows[5], rows[5]]


def test_query(spark):
    df = entries.queries()["op11_bbit_minhash"](spark, DATA)
    assert difference(df, connection(DATA), entries.oracle_sql()["op11_bbit_minhash"]) == ""
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}


@pytest.mark.parametrize("options", [{}, {"rounds": 0, "block": 2000}, {"rounds": 2, "block": 5000}])
def test_direct(spark, options):
    rows = collection(3)
    assert result(spark, rows, **options) == direct(rows)


def test_other_bounds(spark):
    rows = collection(4)[:250]
    assert result(spark, rows, percent=95) == direct(rows, 95)
    assert result(spark, rows, percent=100) == direct(rows, 100)


def test_pairs_at_the_bound_are_candidates():
    """Sets of 400 with a similarity of just 0.85: all share a bucket and pass the estimate."""
    rnd = np.random.default_rng(5)
    number, most, lost = 400, op.least_matches(0.85), 0
    for _ in range(300):
        both = rnd.integers(0, 1 << 63, 2 * number, dtype=np.uint64)
        shared = round(number * 2 * 0.85 / 1.85)
        sides = [both[:number], np.r_[both[:shared], both[number:2 * number - shared]]]
        keys, packed = op.signatures(op.minima(np.concatenate(sides), np.array([number, number])))
        lost += not ((keys[0] == keys[1]).any() and op.matches(packed[0], packed[1]) >= most)
    assert lost == 0


def test_estimate_is_corrected_for_chance(spark):
    rnd = np.random.default_rng(6)
    sets = [rnd.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(60)]
    _, packed = op.signatures(op.minima(np.concatenate(sets), np.full(60, 500)))
    share = np.mean([op.matches(packed[i], packed[j]) for i in range(60) for j in range(i)]) / (op.BANDS * op.WIDTH)
    assert abs((share - 0.25) / 0.75) < 0.01  # unrelated sets
    df = spark.createDataFrame([(packed[0].tolist(), packed[k].tolist(), int(op.matches(packed[0], packed[k]))) for k in range(20)],
                               "packed_a array<long>, packed_b array<long>, expected int")
    assert df.where(op.matches_of("packed_a", "packed_b") != df.expected).count() == 0


def test_a_loose_group_gives_few_links(spark):
    """Members near the bound: what is written grows with the group, not with its pairs."""
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(10**5)}" for _ in range(150)]
    rows = list(enumerate(t for n in (3, 6, 9, 12) for t in copies(rnd, words, 80, n)))
    written = []
    stored = op.stored

    def counting(df, label):
        out = stored(df, label)
        written.append((label, out.count()))
        return out

    op.stored = counting
    try:
        assert result(spark, rows) == direct(rows)
    finally:
        op.stored = stored
    assert max(n for label, n in written if label in ("pairs", "open-links")) <= op.BANDS * len(rows)
    assert dict(written)["open-links"] <= 2 * len(rows)


def test_minima_over_strips(monkeypatch):
    rnd = np.random.default_rng(7)
    number = np.array([0, 5, 0, 0, 17, 1, 30, 0, 3, 0])
    hashes = rnd.integers(0, 1 << 63, number.sum(), dtype=np.uint64)
    whole = op.minima(hashes, number, 8)
    for strip in (1, 3, 7, 22, 23):
        monkeypatch.setattr(op, "STRIP", strip)
        assert (op.minima(hashes, number, 8) == whole).all()
    assert (whole[0] == np.iinfo(np.uint64).max).all()
    assert op.minima(hashes[:0], np.zeros(3, np.int64), 8).shape == (3, 8)


def test_very_long_text(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(10**5)}" for _ in range(900_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-40])), (3, " ".join(words[450_000:]))]
    assert [r[2] for r in result(spark, rows)] == [1, 1, 3]


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]

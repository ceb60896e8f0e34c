"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entries
from footfall.llm import collocations, hat_trie, spans
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(docs, least, most, inside=80, longest=4):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, *words[i:i + m]) for i in range(len(words) - m + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        hidden = any(q[0] == lang and len(q) > len(p) and 100 * b >= inside * a
                     and any(q[i:i + len(words)] == words for i in range(1, len(q) - len(words) + 1)) for q, b in candidates.items())
        cuts = [(2000000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        if not hidden:
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, rank + 1, phrase.decode(), -a, left, right, n[lang], -score) for lang, rows in out.items()
                  for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most]))


def result(spark, docs, **options):
    df = spark.createDataFrame([(k, *d, "x", 1) for k, d in enumerate(docs)], "doc_id long, text string, lang string, phrase string, f int")
    return sorted(tuple(r) for r in collocations.collocations(df.repartition(3), **options).collect())


def made(seed, number=300):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["Ärger", "éa", "the", "THE", "日本", "x y"]
    return [("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(rnd.randint(0, 60))),
             rnd.choice(["en", "de", None, "und"])) for _ in range(number)] + [(None, "en"), ("", "de"), (" .,\t", "fr"), (None, None)]


def test_query(spark):
    df = entries.queries()["op13_collocations"](spark, DATA)
    assert difference(df, connection(DATA), entries.oracle_sql()["op13_collocations"]) == ""
    assert dict(df.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint",
                               "n": "bigint", "score": "bigint"}


@pytest.mark.parametrize("least, most, inside", [(5, 2000, 80), (12, 7, 50), (2, 10000, 100)])
def test_direct(spark, least, most, inside):
    docs = made(least) + [("a b c d e. a b c d", "en")] * 40 + [("b c", "en")] * 9
    assert result(spark, docs, least=least, most=most, inside=inside) == direct(docs, least, most, inside)


def test_runs_that_leave_early(spark, monkeypatch):
    """With tiny containers all runs together hold every count."""
    monkeypatch.setattr(collocations, "MERGED", 50)
    docs = made(3) + [("the the " * 500, "en")]
    names = ["de", "en", "und"]
    rows = [(t or "", names.index("und" if l is None else l)) for t, l in docs if l != "fr"]
    counter = collocations.Counter((1, 2, 3, 4), None, 0)
    counter.trie = hat_trie.HatTrie(burst=16, full=64)
    packs = []

    def take(run):
        keys = [tuple(x) for x in zip(*(c.tolist() for c in run[:2]))]
        assert keys == sorted(set(keys))
        packs.extend(counter.words.runs([run], 7))

    for k in range(0, len(rows), 20):
        some = rows[k:k + 20]
        texts = [spans.LOWER[np.frombuffer(t.encode(), np.uint8)] for t, _ in some]
        offsets = np.cumsum([0] + [len(t) for t in texts])
        for run in counter.add(np.concatenate(texts), offsets, np.array([x for _, x in some]), names, np.arange(3, dtype=np.uint64)):
            take(run)
    for run in counter.trie.spill():
        take(run)
    assert len(counter.trie) == 0
    expected = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, 5):
                expected.update((names[lang], " ".join(words[i:i + m])) for i in range(len(words) - m + 1))
    found = Counter()
    packs.sort(key=lambda p: p.column(0)[0].as_py())
    for part in collocations.merged_runs(iter(packs), 3):
        for lang, words, phrase, f in zip(*(c.to_pylist() for c in part.columns)):
            assert (lang, phrase) not in found and words == phrase.count(" ") + 1  # one partition holds all of a phrase
            found[lang, phrase] = f
    assert found == {k: n for k, n in expected.items() if n >= 3}


def test_trie_bursts_by_levels():
    rnd = np.random.default_rng(1)
    trie = hat_trie.HatTrie(burst=100, full=1 << 30)
    seen = Counter()
    for _ in range(30):
        ids = [rnd.zipf(1.3, 400).clip(1, 50) for _ in range(4)]
        ids[0][:200] = 7  # a hot first word
        ids[1][:100] = 9  # and a hot pair
        assert not list(trie.add(*hat_trie.packed(ids)))
        seen.update(zip(*(x.tolist() for x in ids)))
    assert all(leaf.size <= 100 for leaf in trie.leaves) and trie.starts == sorted(trie.starts) and len(trie) == len(seen)
    got = Counter()
    for high, low, count in trie.spill():
        for *key, n in zip(*(x.tolist() for x in hat_trie.unpacked(high, low)), count.tolist()):
            got[tuple(key)] += n
    assert got == seen


def test_very_long_text(spark):
    text = ("alpha beta gamma. " * 40 + "x " * 30) * 8000
    docs = [(text, "en"), ("alpha beta", "en")]
    assert result(spark, docs, least=30, most=5) == direct(docs, 30, 5)


def test_sections():
    data = np.frombuffer(b"ab cd.ef gh.ij" + b"x" * 20 + b"kl.mn", np.uint8)
    offsets, rows = collocations.sections(data, np.array([0, 14, 34, 39]), 4)
    assert offsets.tolist() == [0, 6, 12, 14, 34, 39] or set([0, 14, 34, 39]) <= set(offsets.tolist())
    assert len(rows) == len(offsets) - 1 and rows.tolist() == sorted(rows.tolist())
    for cut in set(offsets.tolist()) - {0, 14, 34, 39}:
        assert data[cut - 1] == ord(".")


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, None), ("", "en")]) == []

"""Quality and toxicity: held-out accuracy, exact neighbours, gradients and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entries
from footfall.llm import neighbours, spans, toxicity

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "é"), (6, "word " * 60_000), (7, "w" * 200_000), (7, "same row"), (7, "same row"),
       (None, "no id")]


@pytest.mark.parametrize("name, label, threshold, accuracy", [
    ("op4_quality", "quality", 0.3, 0.95), ("op5_toxicity", "toxic", 0.5, 0.9)])
def test_held_out_rows(spark, name, label, threshold, accuracy):
    got = entries.queries()[name](spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(got) == docs
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 50 and np.mean(right) >= accuracy


@pytest.mark.parametrize("module, label", [(neighbours, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(spark, module, label):
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in ODD], "doc_id long, text string, label int, score double")
    some = [(k, f"good text number {k} with plain words") for k in range(100, 140)]
    some += [(k, f"BAD IDIOT!!! {k} $$$ ###") for k in range(140, 180)]
    train = docs.select("doc_id", "text").union(spark.createDataFrame(some, "doc_id long, text string"))
    labels = spark.createDataFrame([(k, int(k >= 140)) for k, _ in some] + [(1, 1), (2, 0), (None, 1), (100, 0), (9999, 1), (7, None)],
                                   f"doc_id long, {label} int")
    model = module.fit(train, labels)
    got = module.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    again = module.score(docs, module.fit(train, labels)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    clear = spark.createDataFrame([(1, "good text number 7 with plain words"), (2, "BAD IDIOT!!! 7 $$$ ###")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in module.score(clear, model).collect()}
    assert scores[1] < 0.5 < scores[2]
    none = module.fit(train, labels.limit(0))
    assert module.score(docs, none).count() == len(ODD)
    assert module.score(docs.limit(0), model).count() == 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdef ,.!"), rng.integers(5, 200))) for _ in range(300)]
    counts = neighbours.pair_counts(*spans.text_bytes(pa.array(texts)))
    labels = rng.integers(0, 2, 200).astype(np.float32)
    space = neighbours.Space(counts[:200], labels)
    got = space.scores(counts[200:], 7)
    for row, score in zip(counts[200:], got):
        vector = neighbours._unit(space._weighted(row[None]) @ space.basis)[0]
        alike = space.vectors @ vector
        top = np.argsort(-alike)[:8]
        weight = alike[top] - alike[top].min() + 1e-9
        assert abs(score - (weight * labels[top]).sum() / weight.sum()) < 1e-3


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = ["one two three four one", "five six", "two two seven eight nine ten"]
    plain, starts, ends, counts = toxicity.split(*spans.text_bytes(pa.array(texts)))
    rows, triples, sizes, back = toxicity.vocabulary(plain, starts, ends)
    index, mask = toxicity._layout(*toxicity.windows(counts)[:2], back)
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.run(net.word_inputs(rows, triples, sizes), index, mask.astype(np.float64))
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    g, (wr, wg), (cr, cg) = net.gradients(rows, triples, sizes, index, mask, labels)
    for name, grad in [*g.items(), ("word", None), ("char", None)]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net.p[name].shape)
            if name == "word":
                at = (wr[0], at[1])
            if name == "char":
                at = (cr[0], at[1])
            old = net.p[name][at]
            net.p[name][at] = old + 1e-4
            up = loss()
            net.p[name][at] = old - 1e-4
            down = loss()
            net.p[name][at] = old
            mine = (grad[at] if grad is not None else wg[wr == at[0]].sum(axis=0)[at[1]] if name == "word"
                    else cg[cr == at[0]].sum(axis=0)[at[1]])
            assert abs((up - down) / 2e-4 - mine) < 2e-3 * max(1, abs(mine)), name


def test_windows_cover_everything():
    counts = np.array([0, 1, 47, 48, 49, 72, 73, 500])
    first, length, owner = toxicity.windows(counts)
    for row, count in enumerate(counts):
        begin = counts[:row].sum()
        seen = {w for f, n in zip(first[owner == row], length[owner == row]) for w in range(f - begin, f - begin + n)}
        assert seen == set(range(count))


def test_a_sample_has_one_row_for_each_id(spark):
    """One id in 5000 rows with many texts is one row, the same in any order."""
    from footfall.llm import labelled

    docs = spark.createDataFrame([(1, f"text {k % 50}") for k in range(5000)] + [(k, f"own {k}") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, toxic int")
    found = [sorted(map(tuple, labelled.sample(d, labels, "toxic", rows).collect()))
             for d in (docs, docs.orderBy("text")) for rows in (100,)]
    assert found[0] == found[1] and len(found[0]) == len({r[0] for r in found[0]}) <= 100
    assert len(labelled.sample(docs, labels, "toxic", 10).collect()) <= 10

"""Decontamination against edit distances of all windows."""

import math
import random
import re

import numpy as np

import __spark_entry__ as entries
from footfall.llm import decontamination as dec

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def nearest(item, text):
    """Least number of word edits from the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for n, w in enumerate(item, 1):
        new = [n]
        for k, t in enumerate(text, 1):
            new.append(min(row[k - 1] + (t != w), row[k] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distances():
    rnd = random.Random(0)
    for _ in range(200):
        item = np.array([rnd.randrange(4) for _ in range(rnd.randint(1, 9))], np.uint64)
        text = np.array([[rnd.randrange(4) for _ in range(9)]], np.uint64)
        size = rnd.randint(0, 9)

        def edits(a, b):
            row = list(range(len(b) + 1))
            for n, x in enumerate(a, 1):
                new = [n]
                for k, y in enumerate(b, 1):
                    new.append(min(row[k - 1] + (x != y), row[k] + 1, new[-1] + 1))
                row = new
            return row

        assert dec.distances(item, text, np.array([size]))[0] == min(edits(list(item), list(text[0][:size])))


def test_whole_table(spark):
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = set()
    for i, item in items.items():
        grams = {tuple(item[k:k + 2]) for k in range(len(item) - 1)}
        for d, text in docs.items():
            if sum(tuple(text[k:k + 2]) in grams for k in range(len(text) - 1)) >= len(item) - 1 - 2 * math.floor(0.2 * len(item)):
                if nearest(item, text) <= math.floor(0.2 * len(item)):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in entries.queries()["op2_decontamination"](spark, DATA).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and want


def test_recall_of_edited_passages(spark):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(800)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.randint(12, 70))] for _ in range(60)]
    docs, want = [], set()
    for d in range(400):
        i = rnd.randrange(60)
        body = list(items[i])
        for _ in range(rnd.randint(0, math.floor(0.2 * len(body)))):
            at, how = rnd.randrange(len(body)), rnd.randrange(3)
            body[at:at + (how != 0)] = [rnd.choice(vocabulary)] if how < 2 else []
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200))]
        at = rnd.randint(0, len(text))
        docs.append((d, " ".join(text[:at]) + "\n" + ", ".join(body).title() + " " + " ".join(text[at:])))
        want.add((d, i))
    docs += [(k, " ".join(rnd.choice(vocabulary) for _ in range(300))) for k in range(400, 450)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(i, " ".join(w), 2) for i, w in enumerate(items)], "item_id long, text string, item_words int")
    for block in (dec.BLOCK_BYTES, 4000):
        got = {(r.doc_id, r.item_id) for r in dec.contaminated(frame, bench, block_bytes=block).collect()}
        assert got <= want and len(got) >= 0.95 * len(want)


def test_recall_of_long_items():
    """Items of several hundred words with as many spread edits as are allowed."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(800)]
    found = total = 0
    for size in (65, 150, 300, 600):
        items = [[rnd.choice(vocabulary) for _ in range(size)] for _ in range(4)]
        index = dec.Index([" ".join(i) for i in items])
        texts = []
        for d in range(12):
            body = list(items[d % 4])
            for at in sorted(rnd.sample(range(size), size // 5), reverse=True):
                body[at:at + rnd.choice((0, 1, 1))] = rnd.choice(([], ["new"], [rnd.choice(vocabulary)]))
            texts.append([rnd.choice(vocabulary) for _ in range(rnd.randint(0, 150))] + body + ["end"] * rnd.randint(0, 50))
        texts.append([rnd.choice(vocabulary) for _ in range(900)])
        got = index.matches(*dec.spans.text_bytes(dec.pa.array([" ".join(t) for t in texts])))
        for row, item, edits, words_of, first in got:
            assert row < 12 and item == row % 4 and words_of == size and edits == nearest(items[item], texts[row])
            assert nearest(items[item], texts[row][first:first + size + edits]) == edits
        found, total = found + len(got), total + 12
    assert found >= 0.95 * total


def test_edges(spark):
    text = "One two, three four five six seven eight nine ten."
    docs = [(1, None), (2, ""), (3, "..."), (4, text), (4, text), (5, "one two three four five six seven eight nine"),
            (6, "one two three four five six seven"), (7, "x " * 100_000 + text.upper()), (8, "one two three four"),
            (None, "É " + text), (9, "w" * 200_000), (10, "ein Übermut größer als der Ärger")]
    items = [(1, text), (2, None), (3, ""), (4, "one two three four"), (None, text), (5, "EIN ÜBERMUT GRÖSSER, ALS DER ÄRGER"),
             (6, "ein übermut größer ALS der ärger")]
    got = sorted((r.doc_id or 0, r.item_id or 0, r.edits, r.first_word) for r in dec.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    held = [(d, e, at) for d, e, at in ((0, 0, 1), (4, 0, 0), (4, 0, 0), (5, 1, 0), (7, 0, 100_000))]
    want = [(d, i, e, at) for d, e, at in held for i in (0, 1)] + [(10, 5, 1, 0), (10, 6, 0, 0)]
    assert got == sorted(want)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dec.contaminated(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame([], "item_id long, text string")).count() == 0

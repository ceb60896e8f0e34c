"""The pipeline and its stages on small tables with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import long_simhash, simhash
from tests.llm.test_simhash import joined

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rnd, n):
    return [rnd.choice("abcdefgh") + "".join(rnd.choice("iklmnop") for _ in range(rnd.randint(1, 7))) for _ in range(n)]


def table(spark, texts):
    rows = [(k, t, "en", "abc"[(k or 0) % 3], len(t or "")) for k, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_whole_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, run in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, run(spark, kept, DATA)
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert kept.columns == COLUMNS
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 0 and {"doc_id", "text", "taken", "target"} <= set(got.columns)
    assert got.join(kept, "doc_id", "left_anti").count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = stage("toxicity")(spark, docs, "/root/testdata/sf0.01")
    left = labels.join(kept, "doc_id", "left_semi").groupBy("toxic").count().collect()
    left, all_of = ({r.toxic: r["count"] for r in x} for x in (left, labels.groupBy("toxic").count().collect()))
    assert left[0] >= 0.97 * all_of[0] and left.get(1, 0) <= 0.2 * all_of[1]


def similar(a, b):
    a, b = ({tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies(spark):
    rnd = random.Random(3)
    texts = [" ".join(words(rnd, rnd.randint(80, 400))) for _ in range(150)]
    near = []
    for k in range(150):
        body = texts[k % 60].split()
        for _ in range(max(1, len(body) // rnd.choice([60, 90, 200]))):
            body[rnd.randrange(len(body))] = "changed"
        near.append(" ".join(body))
    all_texts = list(enumerate(texts + near + [texts[5], texts[5], "", None, " "]))
    df = table(spark, all_texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, size=5, similarity=0.8).collect()}
    truth = joined([(a, 150 + k) for k in range(150) for a in [k % 60] if similar(texts[a], near[k]) >= 0.8], range(300))
    linked = [k for k in range(300) if truth[k] != k]
    assert len(linked) > 80 and sum(got[k] == got[truth[k]] for k in linked) >= 0.95 * len(linked)
    assert all(got[k] == k for k in range(60, 150))  # those without copies
    assert got[300] == got[301] == got[5] == 5 and got[302] == got[303] == got[304] == 302
    # One large group, compared with leaders only.
    crowd = {r.doc_id: r.component_id for r in long_simhash.near_copies(df, 5, 0.8, bucket=1).collect()}
    assert sum(crowd[k] == got[k] for k in range(300)) >= 0.97 * 300
    kept = {r.doc_id for r in stage("simhash_near_dedup")(spark, df, DATA).collect()}
    assert kept == set(got.values())
    assert long_simhash.radius(1.0) == 0 and long_simhash.radius(0.8) < long_simhash.radius(0.5)


def test_repeated_lines_make_no_copies(spark):
    """Menus and signatures repeated inside documents do not outvote the rest; links are similar in truth."""
    rnd = random.Random(12)
    line = " ".join(words(rnd, 12))
    texts = []
    for _ in range(40):
        own = words(rnd, 200)
        texts.append(" ".join(x for k in range(0, 200, 16) for x in (*own[k:k + 16], line)))
    base = words(rnd, 300)
    for k in range(40):  # 0.70 to 0.90: single words changed, far from each other
        body, changed = list(base), 6 + k % 12
        for j in range(changed):
            body[7 + j * (290 // changed)] = f"w{k}x{j}"
        texts.append(" ".join(body))
    texts += [texts[0] + " " + line, texts[1]]
    got = {r.doc_id: r.component_id for r in long_simhash.near_copies(table(spark, list(enumerate(texts))), 5, 0.8).collect()}
    truth = joined([(a, b) for b in range(len(texts)) for a in range(b) if similar(texts[a], texts[b]) >= 0.8], range(len(texts)))
    assert all(got[k] == k for k in range(40)) and got[80] == 0 and got[81] == 1
    assert all(truth[got[k]] == truth[k] for k in range(len(texts)))  # no group joins what exact similarities do not


def test_recall_at_the_bound():
    """Pairs with a similarity of 0.80 to 0.83 are candidates: inside the radius, and in one bucket."""
    import numpy as np
    rng = np.random.default_rng(5)
    found = pairs = 0
    for both in (40, 200, 900):
        for _ in range(400):
            apart = int(both / rng.uniform(0.8, 0.83)) - both
            cut = int(rng.integers(apart + 1))
            values = rng.integers(0, 1 << 63, both + apart, dtype=np.uint64)
            sets = values[:both + cut], np.concatenate([values[:both], values[both + cut:]])
            sizes = np.array([len(x) for x in sets])
            fps = long_simhash.set_fingerprints(np.concatenate(sets), sizes)
            keys = long_simhash.bucket_keys(np.concatenate(sets), sizes)
            near = np.bitwise_count(fps[0] ^ fps[1]).sum() <= long_simhash.radius(0.8)
            pairs, found = pairs + 1, found + bool(near and (keys[0] == keys[1]).any())
    assert found >= 0.95 * pairs


def test_crowded_buckets_lose_no_pair(spark):
    """A bucket with a large component and small ones, whole and in blocks of some members, against all pairs."""
    import numpy as np
    rng = np.random.default_rng(7)
    base, sets = rng.integers(0, 1 << 63, 100, dtype=np.uint64), []
    for k in range(90):  # near copies of one text in a row of small steps, of 15 texts in pairs, and texts of their own
        own = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        if k < 45:
            own[:97 - k % 6] = base[:97 - k % 6]
        elif 60 <= k < 75:
            own[:95] = sets[k - 15][:95]
        sets.append(own)
    fps = long_simhash.set_fingerprints(np.concatenate(sets), np.full(90, 100))
    raw = [(k, 100, bytearray(fps[k].astype("<u8").tobytes()), bytearray(np.sort(sets[k]).astype("<u8").tobytes())) for k in range(90)]
    full = spark.createDataFrame(raw, "fid long, n long, fp binary, hashes binary")
    members = full.select(F.lit(1).cast("long").alias("key"), "fid")
    shared = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    similar_pairs = {(a, b) for b in range(90) for a in range(b) if shared[a, b] / (200 - shared[a, b]) >= 0.8}
    truth, most = joined(similar_pairs, range(90)), long_simhash.radius(0.8)
    assert sum(a < 45 for a, _ in similar_pairs) > 500 and sum(45 <= a for a, _ in similar_pairs) == 15
    for label in (F.col("fid"), F.when(F.col("fid") < 30, 0).otherwise(F.col("fid")).cast("long")):
        labels = full.select("fid", label.alias("label"))
        start = [(0, r.fid) for r in labels.where("label = 0").collect()]
        for block in (1 << 18, 700, 100):
            got = {(r.a, r.b) for r in long_simhash.open_links(members, labels, full, most, 0.8, block).collect()}
            assert got <= similar_pairs
            assert joined(got | set(start), range(90)) == truth
    done = full.select("fid", F.lit(0).cast("long").alias("label"))
    assert long_simhash.open_links(members, done, full, most, 0.8, 700).count() == 0


def test_pivots_lose_no_link():
    rnd = random.Random(1)
    import numpy as np
    base = [rnd.getrandbits(512) for _ in range(4)]
    numbers = []
    for _ in range(120):
        n = rnd.choice(numbers + base)
        for _ in range(rnd.randint(0, 50)):
            n ^= 1 << rnd.randrange(512)
        numbers.append(n)
    fps = np.array([[n >> 64 * k & (2**64 - 1) for k in range(8)] for n in numbers], np.uint64)
    want = joined([(a, b) for a in range(120) for b in range(a) if (numbers[a] ^ numbers[b]).bit_count() <= 60], range(120))
    assert joined(long_simhash.bucket_links(fps, 60), range(120)) == want


def test_repeated_rows_and_null_ids(spark):
    rnd = random.Random(4)
    a, b, c = (" ".join(words(rnd, 60)) for _ in range(3))
    df = table(spark, [(None, a), (None, b), (2, b), (3, c), (3, c), (4, None), (5, "")]).withColumn("body", F.lit(1)).withColumn(
        "mark", F.lit("x"))
    kept = stage("simhash_near_dedup")(spark, df, DATA)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, a), (2, b), (3, c), (4, None)])
    assert kept.columns == df.columns
    for name, run in corpus_pipeline.STAGES:
        out = run(spark, df, DATA)
        assert out.count() >= 1 and run(spark, df.limit(0), DATA).count() == 0
        if name != "mixing":
            assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()


def test_passages_go_from_texts(spark):
    rnd = random.Random(5)
    shared, own = " ".join(words(rnd, 90)), [" ".join(words(rnd, 50)) for _ in range(4)]
    df = table(spark, [(1, own[0] + "\n" + shared), (2, shared + "\n" + own[1]), (3, own[2]), (4, shared), (5, None), (6, "")])
    got = {r.doc_id: (r.text, r.n_chars) for r in stage("suffix_array_dedup")(spark, df, DATA).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert got[3] == (own[2], len(own[2])) and got[5] == (None, None) and got[6] == ("", 0)
    for k in (1, 2):
        assert shared not in got[k][0] and own[k - 1][:40 if k == 1 else 0] in got[k][0] and got[k][1] == len(got[k][0])


def test_passages_of_more_than_50_words_go(spark):
    """51 short words, far below 400 bytes, are a passage; 50 are none."""
    rnd = random.Random(9)
    passage = [rnd.choice("abcdefgh") + rnd.choice("ik") for _ in range(51)]
    fifty = [rnd.choice("abcdefgh") + rnd.choice("lm") for _ in range(50)]
    own = [" ".join(words(rnd, 30)) for _ in range(4)]
    df = table(spark, [(1, own[0] + " " + " ".join(passage) + " " + own[1]), (2, own[2] + "\n" + " ".join(passage)),
                       (3, " ".join(fifty) + " " + own[3]), (4, "x " + " ".join(fifty)), (5, " ".join(passage))])
    got = {r.doc_id: r.text for r in stage("suffix_array_dedup")(spark, df, DATA).collect()}
    assert {k: v.split() for k, v in got.items()} == {1: (own[0] + " " + own[1]).split(), 2: own[2].split(), 3: [*fifty, *own[3].split()],
                                                      4: ["x", *fifty]}


def test_leaks_go(spark):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(3).collect()
    rnd = random.Random(6)
    clean = " ".join(words(rnd, 200))
    df = table(spark, [(1, clean), (2, clean + " " + items[0].text.upper()), (3, items[1].text), (None, items[2].text), (4, None)])
    got = stage("benchmark_decontamination")(spark, df, DATA).collect()
    assert sorted(r.doc_id for r in got) == [1, 4]



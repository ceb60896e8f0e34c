"""Token counts against the libraries, and the cache."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entries
from footfall.llm import token_counts

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts, path=PATH):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def texts():
    rnd = random.Random(2)
    parts = ["a", " ", "  ", "\n", "\t", " ", "　", "é", "ß", "don't", "'s", "'", "12", "3", "<|endoftext|>", "!!", "|", "日本",
             "\U0001f600", "\r\n", "\x1c", "\x85", "The", "THE", "."]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    return ["", " ", "x" * 60_000, "word " * 30_000, *made]


def test_whole_table(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    counts = dict(zip(rows, library(list(rows.values()))))
    got = entries.queries()["op6_token_counts"](spark, DATA).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        k: (len(rows[k].encode()), n, n > 512) for k, n in counts.items()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_texts(spark, name):
    path, made = public_tokenizers.path(name), texts()
    df = spark.createDataFrame([(k, t, 1, "c") for k, t in enumerate([*made, None, made[9]])],
                               "doc_id long, text string, n_tokens int, content string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()}
    assert got == dict(enumerate([*library(made, path), 0, library([made[9]], path)[0]]))


def test_unicode_spaces():
    """Runs of spaces of other kinds are one piece to the tokenizer."""
    rnd = random.Random(7)
    parts = [" ", " ", "\u00a0", "\u00a0 ", "\u2003", "\u3000", "\u1680", "\u2028", "\x85", "\n", "a", "é", "10", "EUR", "."]
    made = ["price: \u00a0 \u00a0 10 \u00a0 \u00a0 \u00a0 \u00a0 EUR", " \u00a0 \u00a0"]
    made += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    counter = token_counts.Counter(PATH)
    assert not counter._whole
    assert counter(*token_counts.spans.text_bytes(token_counts.pa.array(made))).tolist() == library(made)


def test_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PATH, cache).collect()} == {1: 2, 2: 2, 3: 0}
    assert token_counts.read_cache(spark, cache).count() == 2
    more = df.union(spark.createDataFrame([(4, "three")], df.schema))
    assert token_counts.count_tokens(more, PATH, cache).count() == 4
    assert token_counts.read_cache(spark, cache).count() == 3
    # What is stored is used, for its own tokenizer only.
    known = token_counts.read_cache(spark, cache).withColumn("n_tokens", token_counts.F.col("n_tokens") + 100)
    known.write.parquet(other := str(tmp_path / "other"))
    assert {r.n_tokens for r in token_counts.count_tokens(df, PATH, other).collect()} == {102, 100}
    assert {r.n_tokens for r in token_counts.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"), other).collect()} == {2, 0}
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0

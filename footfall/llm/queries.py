"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    bbit_minhash, collocations, decontamination, hard_negatives, maxscore, mixing, neighbours, passages, simhash, suffix_tree, token_counts, toxicity, url_rules)
from footfall.llm.book import query, table
from footfall.llm.labelled import held_out

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op1_url_filters", """
WITH rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) v(rh, rp, rv)),
  rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
  cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
  parts AS (SELECT page_id, coalesce(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(r, length(h) + 1), '^[^?#]*'), '') AS path FROM cut),
  fits AS (SELECT page_id, host, path, rh, rp, rv, row_number() OVER (PARTITION BY page_id
      ORDER BY length(concat(rh, rp)) DESC NULLS LAST) AS k
    FROM parts LEFT JOIN rules ON (host = rh OR right(host, length(rh) + 1) = concat('.', rh))
      AND left(path, length(rp)) = rp)
SELECT page_id, host, path, CASE WHEN rh IS NOT NULL THEN concat(rh, rp) END AS rule, coalesce(rv, 'allow') AS verdict
FROM fits WHERE k = 1""")
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rule_table(spark, RULES)).drop("url")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3)


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, weights=(3, 1, 2), budget=1.5, most=2.0, quality=mixing.variety("text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache's folder is the session's ``footfall.token.cache``, else a new one."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                       spark.conf.get("footfall.token.cache", None))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op9_maxscore", """
WITH usable AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
  parts AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM usable),
  whole AS (SELECT vec_id, k, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts
    WHERE vec_id NOT IN (SELECT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x))),
  scores AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
    FROM whole q JOIN whole d ON q.k = d.k AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, d.vec_id),
  ranked AS (SELECT query_id, vec_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return maxscore.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    space = neighbours.fit(docs, table(spark, sf_dir, "labels"))
    return neighbours.score(docs, space, threshold=0.3).withColumn("held_out", held_out())


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, threshold=0.5).withColumn("held_out", held_out())


@query("op8_suffix_tree")
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


@query("op10_passages")
def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeated(table(spark, sf_dir, "documents"), words=passages.WORDS).drop("kept")


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_hard_negatives", """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
  parts AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM usable),
  whole AS (SELECT vec_id, label, k, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts
    WHERE vec_id NOT IN (SELECT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x))),
  scores AS (SELECT q.vec_id AS anchor, q.label = d.label AS same, d.vec_id AS id, CAST(sum(q.x * d.x) AS BIGINT) AS score
    FROM whole q JOIN whole d ON q.k = d.k AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
    GROUP BY q.vec_id, d.vec_id, q.label = d.label),
  positives AS (SELECT anchor, id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k
    FROM scores WHERE same) WHERE k <= 5),
  negatives AS (SELECT p.anchor, p.id AS positive, p.score AS positive_score, n.id, n.score,
      row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS k
    FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same
      AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(k AS INTEGER) AS rank, id AS negative_id, positive_score,
  score AS negative_score FROM negatives WHERE k <= 10""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    vectors = hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


@query("op13_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
  lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
  totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
  places AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m),
  grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM places),
  f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
  cuts AS (SELECT lang, phrase, m, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp,
    array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rp FROM f, (VALUES (1), (2), (3)) v(k) WHERE k < m),
  scored AS (SELECT c.*, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS BIGINT) AS score FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM scored) WHERE q = 1),
  kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f c WHERE c.lang = b.lang AND c.m > b.m
    AND 100 * c.f >= 80 * b.a AND contains(concat(' ', c.phrase, ' '), concat(' ', b.phrase, ' ')))),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, most=2000, inside=80)


@query("op11_bbit_minhash", r"""
WITH RECURSIVE lists AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM lists),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id),
  links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
  steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach AS (SELECT doc_id, doc_id AS root FROM lists UNION SELECT r.doc_id, s.y FROM reach r JOIN steps s ON s.x = r.root),
  least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)""")
def op11_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)

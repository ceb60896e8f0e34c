"""URL filter: host-suffix and path-prefix expressions, joined with rules on short digests.

Every URL is expanded into the expressions some rule could be written as: its last 1, 2, ... host labels combined
with the first characters of its path, for those (labels, path length) pairs that occur among the rules. The first
four bytes of an expression's SHA-256 find candidate rules; the full digest confirms them; the longest rule wins.
Different URLs are judged once, so a URL with a third of all rows is one row of the join.

Defined cases: a null URL, or one without ``://``, has empty host and path and no rule. Repeated pages each get a row.
Among rules of one length the longer host wins, then block. Repeated rules count once; a rule with a null or empty
host or a null path fits nothing. Columns of the input other than the URL are passed through; those called host, path,
rule or verdict are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SHAPES = 100_000  # pairs of label count and path length among all rules; they become one literal
MAX_RULES_SENT = 100_000  # rules up to this number are broadcast


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path without query and fragment."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(url))
    path = F.regexp_extract(after, "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, the rule that holds for them (else null) and its verdict (else ``default``)."""
    spark = pages.sparkSession
    host, path = split_url(url)
    pages = pages.withColumns({"__host": host, "__path": path}).drop("host", "path", "rule", "verdict")

    rules = rules.where("host <> '' and path is not null and verdict is not null").select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    shapes = rules.groupBy(_labels(F.col("r_host")).alias("n"), F.length("r_path").alias("m")).count().limit(
        MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError("the rules have too many combinations of host labels and path lengths")
    digest = F.sha2(F.concat("r_host", "r_path"), 256)
    rules = rules.withColumns({"full": digest, "short": F.substring(digest, 1, 8)})
    if 0 < sum(s["count"] for s in shapes) <= MAX_RULES_SENT:
        rules = F.broadcast(rules)

    wanted = F.array(*[F.struct(F.lit(s["n"]).alias("n"), F.lit(s["m"]).alias("m")) for s in shapes]) if shapes else (
        F.array().cast("array<struct<n:int,m:int>>"))
    urls = pages.where("__host <> ''").select("__host", "__path").distinct()
    expressions = urls.select("__host", "__path", F.explode(wanted).alias("s")).where(
        (_labels(F.col("__host")) >= F.col("s.n")) & (F.length("__path") >= F.col("s.m"))).select(
        "__host", "__path", F.expr("substring_index(__host, '.', -s.n)").alias("e_host"),
        F.substring(F.col("__path"), F.lit(1), F.col("s.m")).alias("e_path"))
    expressions = expressions.withColumn("e_full", F.sha2(F.concat("e_host", "e_path"), 256))
    hits = expressions.withColumn("short", F.substring("e_full", 1, 8)).join(rules, "short").where(
        (F.col("full") == F.col("e_full")) & (F.col("r_host") == F.col("e_host")) & (F.col("r_path") == F.col("e_path")))
    best = hits.groupBy("__host", "__path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("hosts"),
        (F.col("r_verdict") == "block").alias("blocks"), F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"))).alias("best"))
    columns = [c for c in pages.columns if c not in ("__host", "__path")]

    def result(df: DataFrame, rule: Column, verdict: Column) -> DataFrame:
        return df.select(*columns, F.col("__host").alias("host"), F.col("__path").alias("path"),
                         rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))

    judged = result(pages.where("__host <> ''").join(best, ["__host", "__path"], "left"),
                    F.col("best.rule"), F.col("best.verdict"))
    return judged.unionByName(result(pages.where("__host = ''"), F.lit(None).cast("string"), F.lit(None)))

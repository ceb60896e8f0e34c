"""Classification by large rule tables: each distinct agent text once, stored by digest and joined back.

``functions.agents`` puts every rule into the plan as one expression branch, for each line. Here the distinct texts of a table are
grouped first (combined before the shuffle, so a text that a third of all lines hold is one row of each task), those that the store
lacks are classified, and the lines get the result by a join on the text's digest. One automaton finds the tokens of all rule tables in
one pass over a text; the rule that applies is the first in its table whose token occurs, as in ``agents.match``. Only texts,
names and patterns leave the tasks; versions are read by Spark from a column of patterns, so the plan has the same size for any rules.

The store is a folder of Parquet for each version of the rules (a digest of all tables), below it one folder for each run, so
runs at the same time don't meet. A text that two of them classified is stored twice and used once.

Defined cases: a null text has no browser, system or vendor, is a Desktop and no bot, and is not stored. An empty text is a text; a rule
with an empty token applies to every text. Equal tokens: the first rule counts. Repeated lines each get a row; columns of the lines that
have a result's name are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import agents
from footfall.operators.dimensions import broadcast_if_small
from footfall.sources import tables as src

MOST_RULES = 200_000  # rules of all tables together, which every task gets
STORED = ("digest string, browser_name string, browser_version string, browser_os_name string, browser_os_version string, "
          "device_type string, device_vendor string, request_is_bot int")
RESULTS = tuple(schemas.names(STORED)[1:])


def rules_version(rules: agents.Rules) -> str:
    """Digest of all rule tables."""
    tables = [[list(r) for r in table] for table in rules[:4]] + [list(rules.bot_words)]
    return hashlib.sha256(json.dumps(tables).encode()).hexdigest()[:32]


class FirstMatch:
    """The first rule of each of several tables whose token occurs in a text."""

    def __init__(self, tables: Sequence[Sequence[str]]):
        """``tables``: the tokens of each table, in order."""
        self.always: list[int | None] = [None] * len(tables)
        least: dict[str, dict[int, int]] = {}
        for t, tokens in enumerate(tables):
            for n, token in enumerate(tokens):
                if token:
                    least.setdefault(token, {}).setdefault(t, n)
                elif self.always[t] is None:
                    self.always[t] = n
        self.automaton = ahocorasick.Automaton()
        for token, places in least.items():
            self.automaton.add_word(token, tuple(places.items()))
        self.filled = bool(least)
        if self.filled:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[int | None]:
        found = list(self.always)
        if self.filled:
            for _, places in self.automaton.iter(text):
                for t, n in places:
                    if found[t] is None or n < found[t]:
                        found[t] = n
        return found


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def classified(texts: DataFrame, rules: agents.Rules) -> DataFrame:
    """``STORED`` columns of (digest, text) rows, one for each."""
    if sum(map(len, rules)) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    sent = texts.sparkSession.sparkContext.broadcast(rules)
    kinds = ("browser", "system", "kind", "vendor")

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [list(table) for table in sent.value[:4]]
        first = FirstMatch([[r.token for r in table] for table in tables])
        robots = FirstMatch([[word.lower() for word in sent.value.bot_words]])
        for part in parts:
            found = [first(text) for text in part.column("text").to_pylist()]
            names = [[None if f[t] is None else tables[t][f[t]].name for f in found] for t in range(4)]
            patterns = [["" if f[t] is None else tables[t][f[t]].pattern for f in found] for t in range(2)]
            bots = [int(robots(text)[0] is not None) for text in part.column("lower").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), part.column("text"), *(pa.array(x, pa.string()) for x in (*names, *patterns)),
                 pa.array(bots, pa.int32())], names=["digest", "text", *kinds, "browser_at", "system_at", "bot"])

    schema = "digest string, text string, " + ", ".join(f"{c} string" for c in (*kinds, "browser_at", "system_at")) + ", bot int"
    rows = texts.select("digest", "text", F.lower("text").alias("lower")).mapInArrow(batches, schema)
    version = lambda at: F.when(F.col(at) != "", F.nullif(F.expr(f"regexp_extract(text, {at}, 1)"), F.lit("")))
    return rows.select(
        "digest", F.col("browser").alias("browser_name"), version("browser_at").alias("browser_version"),
        F.col("system").alias("browser_os_name"),
        agents.dotted(version("system_at"), F.col("system")).alias("browser_os_version"),
        agents.device_type(F.col("kind")).alias("device_type"), F.col("vendor").alias("device_vendor"),
        F.col("bot").alias("request_is_bot"))


def stored(lines: DataFrame, folder: str) -> DataFrame:
    """What the store holds."""
    spark = lines.sparkSession
    paths = [f"{folder}/{name}" for name in src.folders(spark, folder) if name.startswith("run-")]
    return spark.read.schema(STORED).parquet(*paths) if paths else schemas.empty(spark, STORED)


def classify(lines: DataFrame, agent: str, store: str, rules: agents.Rules = agents.Rules()) -> DataFrame:
    """The lines with the columns of ``RESULTS``; texts that are new to the store are added to it."""
    folder = f"{store}/rules={rules_version(rules)}"
    texts = lines.where(F.col(agent).isNotNull()).select(digest(F.col(agent)).alias("digest"), F.col(agent).alias("text"))
    missing = texts.distinct().join(stored(lines, folder).select("digest"), "digest", "left_anti")
    classified(missing, rules).write.parquet(f"{folder}/run-{uuid.uuid4().hex}")
    known = stored(lines, folder).dropDuplicates(["digest"]).withColumnRenamed("digest", "__digest")
    rows = lines.withColumn("__digest", digest(F.col(agent))).drop(*RESULTS)
    unknown = agents.device_type(F.lit(None).cast("string"))
    return rows.join(broadcast_if_small(known), "__digest", "left").drop("__digest").withColumns({
        "device_type": F.coalesce("device_type", unknown), "request_is_bot": F.coalesce("request_is_bot", F.lit(0))})

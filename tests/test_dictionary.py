"""Agents by dictionary: against the ordered rules of the plan, with many rules, a store, and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from footfall.functions import agents
from footfall.operators import dictionary
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.001"


def ordered(text, table):
    return next((n for n, r in enumerate(table) if text is not None and r.token in text), None)


def test_query(spark):
    df = entries.queries()["enrich_agent_dictionary"](spark, DATA)
    assert difference(df, connection(DATA), entries.oracle_sql()["enrich_agent_dictionary"]) == ""


def test_equals_the_rules_of_the_plan(spark, tmp_path):
    rnd = random.Random(3)
    words = [r.token for table in agents.Rules()[:4] for r in table] + ["Version/17.1", "Googlebot", "CPU OS 16_2", " 10.0", " 6.1", "/12.3", "_4"]
    texts = [None, "", "İ Bot", "é" * 5000 + "Firefox/3"] + ["".join(rnd.choices(words, k=rnd.randrange(1, 7))) for _ in range(400)]
    lines = spark.createDataFrame([(t, k) for k, t in enumerate(texts + texts[:9])], "a string, line int")
    browser, system, kind, vendor = (agents.match(F.col("a"), table) for table in agents.Rules()[:4])
    want = lines.select("a", "line", agents.name(browser, agents.BROWSERS), agents.version(F.col("a"), browser, agents.BROWSERS),
                        agents.name(system, agents.SYSTEMS), agents.system_version(F.col("a"), system),
                        agents.device_type(agents.name(kind, agents.DEVICE_KINDS)), agents.name(vendor, agents.VENDORS),
                        agents.is_bot(F.col("a")))
    got = dictionary.classify(lines, "a", str(tmp_path / "store")).select("a", "line", *dictionary.RESULTS)
    assert {r.line: tuple(r) for r in got.collect()} == {r.line: tuple(r) for r in want.collect()}
    assert got.count() == len(texts) + 9


@pytest.mark.parametrize("number", [10_000])
def test_many_rules(spark, tmp_path, number):
    rnd = random.Random(5)
    table = [agents.Rule("".join(rnd.choices("abcd", k=rnd.randrange(2, 7))), r"([0-9]+)", f"n{k}") for k in range(number)]
    rules = agents.Rules(browsers=table, systems=table[::-1], device_kinds=[agents.Rule("", "", "console")], vendors=[], bot_words=[])
    texts = ["".join(rnd.choices("abcdxyz019", k=40)) for _ in range(300)] + ["none"]
    lines = spark.createDataFrame([(t,) for t in texts * 3], "a string")
    got = dictionary.classify(lines, "a", str(tmp_path / "store"), rules)
    for r in got.distinct().collect():
        first, last = ordered(r.a, table), ordered(r.a, table[::-1])
        assert r.browser_name == (None if first is None else table[first].name)
        assert r.browser_os_name == (None if last is None else table[::-1][last].name)
        assert (r.device_type, r.device_vendor, r.request_is_bot) == ("Console", None, 0)
    digests = lines.select(dictionary.digest(F.col("a")).alias("digest"), F.col("a").alias("text"))
    plans = [dictionary.classified(digests, some)._jdf.queryExecution().optimizedPlan().toString() for some in (agents.Rules(), rules)]
    assert plans[0].count("\n") == plans[1].count("\n") and len(plans[1]) < 1.1 * len(plans[0])


def test_store_classifies_each_text_once(spark, tmp_path):
    store, rules = str(tmp_path / "store"), agents.Rules()
    folder = f"{store}/rules={dictionary.rules_version(rules)}"
    first = spark.createDataFrame([("Firefox/1",), ("Firefox/1",), ("Chrome/2",), (None,)], "a string")
    assert dictionary.classify(first, "a", store).count() == 4
    assert dictionary.stored(first, folder).count() == 2
    again = spark.createDataFrame([("Firefox/1",), ("Edg/3",)], "a string")
    before = dictionary.classify(again, "a", store)
    assert sorted((r.browser_name, r.browser_version) for r in before.collect()) == [("Edge", "3"), ("Firefox", "1")]
    assert dictionary.stored(first, folder).count() == 3
    # A text that two runs classified at the same time is used once; other rules have a store of their own.
    dictionary.stored(first, folder).write.parquet(f"{folder}/run-other")
    assert dictionary.classify(again, "a", store).count() == 2
    own = rules._replace(browsers=[agents.Rule("fox", "", "Fox")])
    assert {r.browser_name for r in dictionary.classify(again, "a", store, own).collect()} == {"Fox", None}
    assert dictionary.stored(first, folder).count() == 6


def test_odd_inputs(spark, tmp_path):
    store = str(tmp_path / "store")
    empty = spark.createDataFrame([], "a string, device_type int")
    assert dictionary.classify(empty, "a", store).count() == 0
    clash = spark.createDataFrame([("iPad", 7)], "a string, device_type int")
    assert [r.device_type for r in dictionary.classify(clash, "a", store).collect()] == ["Tablet"]
    with pytest.raises(ValueError):
        dictionary.classified(clash, agents.Rules(bot_words=["x"] * (dictionary.MOST_RULES + 1)))

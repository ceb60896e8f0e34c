"""URL rules against a direct reading of their definition."""

from pyspark.sql import Row

import __spark_entry__ as entries
from footfall.llm import url_rules
from footfall.llm.queries import RULES
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.001"


def direct(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [None, "", "nothing", "http://", "http://?x", "http://org", "HTTP://A.Example.ORG/es/x?y#z", "https://example.org/en/12",
        "https://x.example.org/en/2", "http://corg/es/", "http://a.com/fr/1", "http://com/de/", "http://a.com/fr", "a://b://c.com/de/",
        "http://.org/", "http://org./", "http://é.com/de/é", "http://a.com/de/" + "x" * 100_000, "http://" + "a." * 5000 + "com/fr/",
        "http://a.com/de/1", "http://a.com/de/1"]


def test_direct(spark):
    rows = [Row(page_id=k, url=u, rule="mine", host=1) for k, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host int")
    rules = RULES + [("com", "/de/", "block"), ("", "/", "block"), ("a.com", "/d", "allow"), ("com", "/de/x", "allow")]
    got = url_rules.judge(df, url_rules.rule_table(spark, rules)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {
        k: direct(u, rules) for k, u in enumerate(URLS)}
    assert len(got) == len(URLS)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none, url_rules.rule_table(spark, RULES)).count() == 0
    some = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    got = url_rules.judge(some, url_rules.rule_table(spark, RULES).limit(0)).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")]


def test_query(spark):
    df = entries.queries()["op1_url_filters"](spark, DATA)
    assert difference(df, connection(DATA), entries.oracle_sql()["op1_url_filters"]) == ""

"""Log lines: known results, every reason to drop a line, and odd encodings."""

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import agents, urls
from footfall.operators import manifest, parsing

# Agent, address, host, path and time go into the ids below.
AGENT = ("Mozilla/5.0%20(Macintosh;%20Intel%20Mac%20OS%20X%2010_15_7)%20AppleWebKit/537.36"
         "%20(KHTML,%20like%20Gecko)%20Chrome/107.0.0.0%20Safari/537.36")
# One date's salt and the ids it must give.
SALT = ("2022-11-20", "2a962459bea054ecb82b91ced4f274fe5f24c01b")
VISITOR = "f2fddd08aeb4ab0ba7e39a806a502f4686bbbbbcf52542ad7b327169304ea7b0"
PAGE_OF_DAY = "81e7a875af519fc2beeb2544b336a2b5d1b4f3f4218843b221deea83b0e3e812"
PAGE_VIEW = "b62e7038fd22d1e39a618e7c758e423a65c9448544e9027bcd3c5026cbc7f705"
EVENT_PAGE_OF_DAY = "95b053d31bb37582244457b224817c871c0ffb72bd0af38224b459510b96c7b4"
EVENT_PAGE_VIEW = "9857501b43de2ba28def6e5c3597158cb7c700ea61d9b88a6b432c4784180e90"
CET = " GMT+0100 (GMT+01:00)"

VIEW_QUERY = ("dk=k1&t=pv&ts=1668968526289&u=http%253A%252F%252Flocalhost%253A3000%252Fazure&hn=localhost"
              "&pa=%252Fazure&iw=1356&ih=902&w=3440&h=1440&d=24&l=de-DE&p=MacIntel&m=8&c=8&tz=Europe%252FBerlin")
EVENT_QUERY = ("dk=k1&t=tr&ts=1668974875096&u=http%253A%252F%252Flocalhost%253A3000%252Fgooglecloud&hn=localhost"
               "&pa=%252Fgooglecloud&en=tabHidden&pr=%257B%257D")


def line(query=VIEW_QUERY, time="1668968526.477", stem="/hello.gif", edge="HAM50-C2", taken="0.000",
         agent=AGENT, referer="http://localhost:3000/", asn="3320"):
    return "\t".join([time, "91.48.244.135", "200", stem, "319", edge, taken, agent, referer, query, "Hit", asn])


@pytest.fixture
def parse(spark):
    domains = spark.createDataFrame(
        [("localhost", "k1", None), ("site.example", "k2", None)], schemas.DOMAINS)
    edges = spark.createDataFrame(
        [("HAM", "Hamburg", "Hamburg", "Germany", "DE", 53.630401611328, 9.9882297515869)], schemas.EDGES)
    salts = spark.createDataFrame([SALT], "event_date string, salt string").withColumn(
        "event_date", F.col("event_date").cast("date"))

    def run(*lines, outcomes=False, **options):
        raw = spark.createDataFrame([(text,) for text in lines], "value string")
        df = parsing.parse_outcomes(raw, domains, edges, salts, **options)
        return [r.asDict() for r in (df if outcomes else parsing.accepted(df)).collect()]

    return run


def test_page_view(parse):
    (row,) = parse(line() + "\n")
    assert len(row) == 51
    expected = {
        "event_year": 2022, "event_month": 11, "event_day": 20, "arrival_delay_ms": 289,
        "edge_city": "Hamburg", "edge_state": "Hamburg", "edge_country": "Germany", "edge_country_code": "DE",
        "edge_id": "HAM", "referrer": None, "referrer_domain_name": "Direct / None",
        "browser_name": "Chrome", "browser_version": "107.0.0.0", "browser_os_name": "Mac OS",
        "browser_os_version": "10.15.7", "browser_timezone": "Europe/Berlin", "browser_language": "de-DE",
        "device_type": "Desktop", "device_vendor": "Apple", "device_outer_resolution": "3440x1440",
        "device_inner_resolution": "1356x902", "device_color_depth": 24, "device_platform": "MacIntel",
        "device_memory": 8.0, "device_cores": 8, "utm_source": None, "utm_term": None,
        "request_url": "http://localhost:3000/azure", "request_path": "/azure", "request_query_string": VIEW_QUERY,
        "request_bytes": 319, "request_status_code": 200, "request_cache_status": "Hit",
        "request_delivery_time_ms": 0, "request_asn": 3320, "request_is_bot": 0, "event_name": None,
        "event_data": None, "daily_page_view_id": PAGE_OF_DAY, "daily_visitor_id": VISITOR,
        "domain_name": "localhost", "event_type": "pageview",
    }
    assert {k: row[k] for k in expected} == expected
    assert str(row["event_timestamp"]) == "2022-11-20 18:22:06.289000"
    assert str(row["arrival_timestamp"]) == "2022-11-20 18:22:06"
    assert abs(row["edge_latitude"] - 53.6304) < 1e-4


def test_custom_event(parse):
    (row,) = parse(line(EVENT_QUERY, "1668974875.161", taken="0.001"))
    assert (row["event_type"], row["event_name"], row["event_data"]) == ("event", "tabHidden", "{}")
    assert (row["daily_visitor_id"], row["daily_page_view_id"]) == (VISITOR, EVENT_PAGE_OF_DAY)
    assert not {"client_ip", "agent", "user_agent", "salt"} & set(row)
    assert not any("91.48.244.135" in str(v) for v in row.values())
    assert row["request_delivery_time_ms"] == 1 and row["browser_language"] is None


def test_page_view_ids_with_the_zone_they_were_made_in(spark, parse):
    spark.conf.set("spark.sql.session.timeZone", "GMT+01:00")
    try:
        rows = parse(line(), line(EVENT_QUERY, "1668974875.161"), zone=CET)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r["page_view_id"] for r in rows} == {PAGE_VIEW, EVENT_PAGE_VIEW}


def test_referrer_and_campaign(parse):
    def linked(url):
        return line(VIEW_QUERY + "&ute=own&r=" + url)

    rows = {r["request_query_string"].rsplit("&r=")[1]: r for r in parse(
        linked("https%253A%252F%252Fnews.example%252F"),
        linked("http%253A%252F%252Flocalhost%253A3000%252Fx"),
        linked("https%253A%252F%252Fcdn.example%252Fx"),
        linked("https%253A%252F%252Fx.example%252F%253Futm_source%253Dnews%2526utm_term%253Dlast"),
        cdn_host="cdn.example")}
    got = {k: (r["referrer"], r["referrer_domain_name"], r["utm_source"], r["utm_term"]) for k, r in rows.items()}
    assert list(sorted(got.values(), key=str)) == [
        ("https://news.example/", "news.example", None, "own"),
        ("https://x.example/?utm_source=news&utm_term=last", "x.example", "news", "own"),
        (None, "Direct / None", None, "own"),
        (None, "Direct / None", None, "own"),
    ]


def test_keys_are_decoded(parse):
    (row,) = parse(line(VIEW_QUERY.replace("&ts=", "&%74s=").replace("&pa=", "&%70a=") + "&us%6F=src&%zz=1&u+o=2"))
    assert (str(row["event_timestamp"]), row["request_path"], row["utm_source"]) == (
        "2022-11-20 18:22:06.289000", "/azure", "src")


def test_own_rules(parse):
    rules = agents.Rules(browsers=[agents.Rule("Safari/", r"Safari/([\d.]+)", "Webkit")], systems=[], device_kinds=[
        agents.Rule("Macintosh", "", "console")], vendors=[], bot_words=["macintosh"])
    (row,) = parse(line(), rules=rules)
    assert (row["browser_name"], row["browser_version"], row["browser_os_name"], row["browser_os_version"]) == (
        "Webkit", "537.36", None, None)
    assert (row["device_type"], row["device_vendor"], row["request_is_bot"]) == ("Console", None, 1)


DROPPED = [
    ("a\tb", "arity"),
    ("", "arity"),
    (line() + "\textra", "arity"),
    (line(stem="/go.js", query="-"), "path"),
    (line(stem="/versions/hello-1.js", query="-"), "path"),
    (line(query="-"), "no_query"),
    (line(VIEW_QUERY.replace("1668968526289", "soon")), "timestamp"),
    (line(VIEW_QUERY.replace("1668968526289", "99999999999999999")), "timestamp"),
    (line(VIEW_QUERY.replace("1668968526289", "9" * 40)), "timestamp"),
    (line(time="x"), "timestamp"),
    (line(VIEW_QUERY + "&uso=%zz"), "encoding"),
    (line(VIEW_QUERY + "&uso=%25zz"), "encoding"),
    (line(agent="%zz"), "encoding"),
    (line(VIEW_QUERY + "&uso=%FF"), "encoding"),
    (line(VIEW_QUERY + "&uso=a%25C3%2528"), "encoding"),
    (line(agent="Chrome/1%80"), "encoding"),
    (line(VIEW_QUERY.replace("&ts=1668968526289", "&x=1&%74%73=soon")), "timestamp"),
    (line(VIEW_QUERY + "&r=nowhere"), "referrer"),
    (line(VIEW_QUERY.replace("dk=k1", "dk=k2")), "unverified"),
    (line(VIEW_QUERY.replace("dk=k1&", "")), "unverified"),
    (line(VIEW_QUERY.replace("1668968526289", "1668868526289")), "no_salt"),
    (line("t=id&ts=1668968526289&uid=7&dk=k1"), "unverified"),
    (line("dk=k2&t=pv", stem="/noscript.gif?n=1", referer="https://www.site.example/p?q=1"), "timestamp"),
]


def test_dropped(parse):
    rows = {r["value"]: r for r in parse(*[text for text, _ in DROPPED], outcomes=True)}
    assert {text: rows[text]["error"] for text, _ in DROPPED} == dict(DROPPED)
    assert {r["result"] for r in rows.values()} == {"Dropped"}
    message = rows[line(VIEW_QUERY.replace("dk=k1", "dk=k2"))]["message"]
    assert message == "Couldn't verify 'localhost' with domain key 'k2'!"


def test_unread_broken_escapes_do_no_harm(parse):
    # The payload of an event is not read on page views.
    assert len(parse(line(VIEW_QUERY + "&ti=100%25"), line(VIEW_QUERY + "&pr=%25zz"))) == 2


def test_odd_numbers_never_fail(parse):
    odd = [line(taken=t, asn=a) for t, a in [("1e300", "9" * 30), ("NaN", "12ab"), ("Infinity", ""), ("-", " 7 ")]]
    rows = sorted((r["request_asn"] or 0, r["request_delivery_time_ms"]) for r in parse(*odd))
    assert rows == [(0, None), (0, None), (7, None), (12, None)]


def test_script_less_hits(parse):
    hit = line("dk=k2&t=pv", stem="/noscript.gif?n=1", referer="https://www.site.example/p?q=1")
    (row,) = parse(hit, noscript_fallback=True)
    assert (row["domain_name"], row["request_path"]) == ("site.example", "/noscript.gif")
    assert row["event_timestamp"] == row["arrival_timestamp"]


def test_query_values(spark):
    q = "a=1&b=x%252By+z&a=2&c&d=&e=%25E2%2582%25AC&f=k=v"
    df = spark.createDataFrame([(q,)], "q string")
    row = df.select(*[urls.query_param(F.col("q"), k).alias(k) for k in "abcdefg"]).first().asDict()
    assert row == {"a": "1", "b": "x+y z", "c": None, "d": None, "e": "€", "f": "k=v", "g": None}


def test_url_parts(spark):
    cases = {
        "https://User:pw@Shop.Example:8080/a/b?x=/c#d": ("shop.example", "/a/b"),
        "http://[::1]:80/": ("[::1]", "/"),
        "https://x.example?q=1": ("x.example", None),
        "android-app://com.app/": ("com.app", "/"),
        "no url": (None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    rows = df.select("u", urls.url_host(F.col("u")), urls.url_path(F.col("u"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_device_types(spark):
    df = spark.createDataFrame([("smarttv",), ("wearable",), ("fridge",), (None,)], "k string")
    assert [r[0] for r in df.select(agents.device_type(F.col("k"))).collect()] == [
        "SmartTV", "Wearable", "Desktop", "Desktop"]


def test_own_rules_extend_the_agents(spark):
    rules = [agents.Rule("MyApp/", r"MyApp/(\d+)", "My App"), *agents.BROWSERS]
    df = spark.createDataFrame([("MyApp/3 Chrome/1.0",), ("Edg/9.1 Chrome/9",), ("curl/8",)], "a string")
    df = df.withColumn("n", agents.match(F.col("a"), rules))
    got = [tuple(r) for r in df.select(agents.name(F.col("n"), rules),
                                       agents.version(F.col("a"), F.col("n"), rules)).collect()]
    assert got == [("My App", "3"), ("Edge", "9.1"), (None, None)]


def test_object_keys(spark):
    cases = {
        "incoming/domain_name=mydomain.com/event_type=pageview/event_date=2022-11-29/f.parquet":
            ("cleaned", "pageview", "mydomain.com", "2022-11-29", "f.parquet", None, None),
        "aggregated/stats/domain_name%3Dmydomain.com/event_date=2022-11-29/data_0.parquet":
            ("curated", "stats", "mydomain.com", "2022-11-29", "data_0.parquet", None, None),
        "aggregated/events/domain_name=a.b/event_date=2022-11-29/event_name=signup/x.parquet":
            ("curated", "events", "a.b", "2022-11-29", "x.parquet", None, "signup"),
        "aggregated/daily-stats/event_date=2022-11-29/event_hour=7/s.parquet":
            ("curated", "daily-stats", None, "2022-11-29", "s.parquet", 7, None),
        "other/x": (None, None, None, "None", "x", None, None),
    }
    rows = manifest.parse_keys(spark.createDataFrame([(k, k) for k in cases], "given string, s3_key string"))
    assert {r.given: (r.file_type, r.file_sub_type, r.file_domain_name, str(r.file_event_date), r.file_name,
                      r.file_event_hour, r.file_event_name) for r in rows.collect()} == cases

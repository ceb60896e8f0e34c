"""Access-log lines to cleaned events.

One chain of projections plus three dimension joins. Nothing in it throws on bad
input: every reason to reject a line ends up in the ``error`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import agents, ids, times, urls
from footfall.operators import dimensions

# Fields of a line, in order.
FIELDS = [
    "log_time", "client_ip", "status", "uri_stem", "bytes", "edge_location", "time_taken",
    "user_agent", "referer_header", "uri_query", "cache_status", "asn",
]
SCRIPT_PIXEL = "/hello.gif"
NOSCRIPT_PIXEL = "/noscript.gif"

# Tracker parameter -> meaning.
PARAMS = {
    "dk": "domain_key", "t": "type", "ts": "time", "u": "url", "hn": "host", "pa": "path",
    "ua": "agent", "r": "referrer", "iw": "inner_width", "ih": "inner_height",
    "w": "outer_width", "h": "outer_height", "d": "color_depth", "l": "language",
    "p": "platform", "m": "memory", "c": "cores", "tz": "timezone", "uso": "utm_source",
    "uca": "utm_campaign", "ume": "utm_medium", "uco": "utm_content", "ute": "utm_term",
    "en": "event_name", "pr": "event_data",
}
EVENT_ONLY = {"event_name", "event_data"}
UTM = ["utm_source", "utm_campaign", "utm_medium", "utm_content", "utm_term"]
# The tracker's type codes, and the name of visits without referrer.
EVENT_TYPES = {"pv": "pageview", "tr": "event"}
DIRECT = "Direct / None"


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """Make later filters and projections read these columns instead of recomputing them.

    Catalyst moves filters below projections by copying their expressions, which for
    long parsing chains means evaluating them again and again. The output of a
    generator is never copied.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def split_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """Line text to the twelve named fields, plus the number of fields found."""
    parts = lines.withColumn("_parts", F.split(F.col(value), "\t"))
    fields = [F.get("_parts", i).alias(name) for i, name in enumerate(FIELDS)]
    return parts.select(F.col(value).alias("value"), F.size("_parts").alias("field_count"), *fields)


def gate(fields: DataFrame) -> DataFrame:
    """Add ``error`` for lines that are no tracker hits at all, and ``is_noscript``."""
    stem = F.col("uri_stem")
    hit = stem.startswith(SCRIPT_PIXEL) | stem.startswith(NOSCRIPT_PIXEL)
    return fields.withColumn(
        "error", F.when(F.col("field_count") != len(FIELDS), "arity").when(~hit, "path")
    ).withColumn("is_noscript", F.coalesce(stem.contains(NOSCRIPT_PIXEL), F.lit(False)))


def event_type(code: Column) -> Column:
    """Stored event type of the tracker's type code."""
    chain = F.when(F.lit(False), "na")
    for key, name in EVENT_TYPES.items():
        chain = chain.when(code == key, name)
    return chain.otherwise("na")


def with_params(fields: DataFrame) -> DataFrame:
    """Add the decoded tracker parameters as one array, read with ``param``.

    ``is_malformed`` tells whether a parameter that matters cannot be decoded.
    """
    query = F.when(F.col("error").isNull() & (F.col("uri_query") != "-"), F.col("uri_query"))
    split = fields.withColumn("_keys", urls.param_keys(query)).withColumn("_values", urls.param_values(query))
    raw = split.withColumn("_raw", F.array(*[
        urls.pick_param(F.col("_keys"), F.col("_values"), key) for key in PARAMS])).drop("_keys", "_values")
    each = [F.get("_raw", F.lit(i)) for i in range(len(PARAMS))]
    decoded = raw.withColumn("_params", F.array(*[urls.decode_param(value) for value in each]))
    is_event = event_type(param("type")) == "event"
    malformed = F.lit(False)
    for value, name in zip(each, PARAMS.values()):
        broken = value.isNotNull() & param(name).isNull()
        malformed = malformed | (broken & is_event if name in EVENT_ONLY else broken)
    checked = decoded.withColumn("is_malformed", malformed)
    return computed_once(checked.drop("_raw"), "_params", "is_malformed")


def param(name: str) -> Column:
    """A decoded parameter added by ``with_params``; NULL when absent or malformed."""
    return F.get("_params", list(PARAMS.values()).index(name))


def read_hits(lines: DataFrame, value: str = "value", cdn_host: str | None = None,
              noscript_fallback: bool = False, rules: agents.Rules = agents.Rules()) -> DataFrame:
    """Everything that can be read from a line without looking anything up.

    ``rules`` are the agent and bot tables.

    ``noscript_fallback`` keeps pixel hits of browsers without scripts: time and
    page then come from the arrival time and the Referer header.
    """
    df = with_params(gate(split_fields(lines, value)))
    noscript = F.col("is_noscript")
    header = F.when(F.col("referer_header") != "-", F.col("referer_header"))
    rescue = noscript if noscript_fallback else F.lit(False)

    df = df.withColumns({
        "arrival_timestamp": times.from_seconds(urls.leading_int(F.col("log_time"))),
        "agent": urls.percent_decode(F.col("user_agent")),
        "_client_time": times.from_millis(urls.leading_int(param("time"))),
        "_referrer_host": F.when(urls.is_absolute_url(param("referrer")),
                                 F.coalesce(urls.url_host(param("referrer")), F.lit(""))),
        "_header_host": urls.url_host(header),
    })
    own = F.col("_referrer_host") == param("host")
    if cdn_host is not None:
        own = own | (F.col("_referrer_host") == cdn_host)
    df = df.withColumns({
        "event_timestamp": F.when(rescue, F.coalesce("_client_time", "arrival_timestamp"))
                            .otherwise(F.col("_client_time")),
        "referrer": F.when(F.coalesce(own, F.lit(False)), None).otherwise(param("referrer")),
    })
    referrer_query = urls.url_query(F.col("referrer"))
    df = df.withColumns({
        "_ref_keys": urls.param_keys(referrer_query),
        "_ref_values": urls.param_values(referrer_query),
        "_shown_agent": F.when(noscript, F.coalesce(param("agent"), F.col("agent"))).otherwise(F.col("agent")),
    })

    df = df.withColumns({
        "_browser": agents.match(F.col("_shown_agent"), rules.browsers),
        "_system": agents.match(F.col("_shown_agent"), rules.systems),
    })

    def utm(name: str) -> Column:
        from_referrer = urls.decode_param(urls.pick_param(F.col("_ref_keys"), F.col("_ref_values"), name))
        return F.when(noscript, from_referrer).otherwise(F.coalesce(param(name), from_referrer))

    def size(width: str, height: str) -> Column:
        return F.concat(param(width), F.lit("x"), param(height))

    shown_agent, browser, system = F.col("_shown_agent"), F.col("_browser"), F.col("_system")
    kind = event_type(param("type"))
    stem_path = F.substring_index("uri_stem", "?", 1)
    out = df.select(
        "value", "field_count", "is_noscript", "client_ip", "agent", "arrival_timestamp", "event_timestamp",
        param("domain_key").alias("domain_key"),
        F.when(rescue, F.regexp_replace(F.col("_header_host"), r"^www\.", ""))
         .otherwise(param("host")).alias("domain_name"),
        F.to_date("event_timestamp").alias("event_date"),
        F.year("event_timestamp").alias("event_year"),
        F.month("event_timestamp").alias("event_month"),
        F.dayofmonth("event_timestamp").alias("event_day"),
        (F.unix_millis("event_timestamp") - F.unix_millis("arrival_timestamp")).alias("arrival_delay_ms"),
        F.substring("edge_location", 1, 3).alias("edge_id"),
        "referrer",
        F.when(F.col("referrer").isNull(), DIRECT)
         .otherwise(F.coalesce(urls.blank_to_null(F.col("_referrer_host")), F.lit(DIRECT)))
         .alias("referrer_domain_name"),
        agents.name(browser, rules.browsers).alias("browser_name"),
        agents.version(shown_agent, browser, rules.browsers).alias("browser_version"),
        agents.name(system, rules.systems).alias("browser_os_name"),
        agents.system_version(shown_agent, system, rules.systems).alias("browser_os_version"),
        param("timezone").alias("browser_timezone"),
        param("language").alias("browser_language"),
        agents.device_type(agents.name(agents.match(shown_agent, rules.device_kinds), rules.device_kinds)).alias("device_type"),
        agents.name(agents.match(shown_agent, rules.vendors), rules.vendors).alias("device_vendor"),
        size("outer_width", "outer_height").alias("device_outer_resolution"),
        size("inner_width", "inner_height").alias("device_inner_resolution"),
        urls.leading_int(param("color_depth"), "int").alias("device_color_depth"),
        param("platform").alias("device_platform"),
        urls.leading_int(param("memory")).cast("float").alias("device_memory"),
        urls.leading_int(param("cores"), "int").alias("device_cores"),
        *[utm(name).alias(name) for name in UTM],
        F.when(noscript, header).otherwise(param("url")).alias("request_url"),
        F.when(noscript, stem_path).otherwise(param("path")).alias("request_path"),
        F.when(F.col("uri_query") != "-", F.col("uri_query")).alias("request_query_string"),
        urls.leading_int(F.col("bytes")).alias("request_bytes"),
        urls.leading_int(F.col("status"), "int").alias("request_status_code"),
        F.col("cache_status").alias("request_cache_status"),
        F.round(urls.leading_number(F.col("time_taken")) * 1000).try_cast("bigint")
         .alias("request_delivery_time_ms"),
        urls.leading_int(F.col("asn")).alias("request_asn"),
        agents.is_bot(F.col("agent"), rules.bot_words).alias("request_is_bot"),
        kind.alias("event_type"),
        F.when(kind == "event", param("event_name")).alias("event_name"),
        F.when(kind == "event", param("event_data")).alias("event_data"),
        F.coalesce(
            F.col("error"),
            F.when(F.coalesce(F.col("uri_query"), F.lit("-")) == "-", "no_query"),
            F.when(F.col("is_malformed") | F.col("agent").isNull(), "encoding"),
            F.when(F.col("arrival_timestamp").isNull() | F.col("event_timestamp").isNull(), "timestamp"),
            F.when(param("referrer").isNotNull() & F.col("_referrer_host").isNull(), "referrer"),
            F.when(noscript & ~rescue, "noscript"),
        ).alias("error"),
    )
    return out


def pseudonymise(hits: DataFrame, zone: str = ids.TIME_TEXT_ZONE) -> DataFrame:
    """Replace address and agent by the salted ids; both source columns are dropped."""
    visitor = [F.col(c) for c in ("salt", "client_ip", "agent", "event_date", "domain_name")]
    path = F.col("request_path")
    return hits.withColumns({
        "daily_visitor_id": ids.visitor_id(*visitor),
        "daily_page_view_id": ids.daily_page_view_id(*visitor, path),
        "page_view_id": ids.page_view_id(*visitor, path, F.col("event_timestamp"), zone),
    }).drop("client_ip", "agent", "salt")


def parse_outcomes(lines: DataFrame, domains: DataFrame, edges: DataFrame, salts: DataFrame,
                   value: str = "value", cdn_host: str | None = None,
                   noscript_fallback: bool = False, zone: str = ids.TIME_TEXT_ZONE,
                   rules: agents.Rules = agents.Rules()) -> DataFrame:
    """Every line with its ``result`` (Ok or Dropped), ``error`` kind and parsed columns.

    The original line is kept for rejected rows and dropped for accepted ones.
    """
    hits = read_hits(lines, value, cdn_host, noscript_fallback, rules)
    known = dimensions.mark_verified(hits, domains)
    placed = dimensions.with_salt(dimensions.with_location(known, edges), salts)
    checked = placed.withColumn("error", F.coalesce(
        F.col("error"),
        F.when(~F.col("is_verified"), "unverified"),
        F.when(F.col("salt").isNull(), "no_salt")))
    out = pseudonymise(checked, zone)
    ok = F.col("error").isNull()
    return out.select(
        F.when(ok, "Ok").otherwise("Dropped").alias("result"), "error",
        F.when(F.col("error") == "unverified",
               dimensions.unverified_message(F.col("domain_name"), F.col("domain_key"))).alias("message"),
        F.when(~ok, F.col("value")).alias("value"),
        *schemas.names(schemas.INCOMING))


def accepted(outcomes: DataFrame) -> DataFrame:
    return schemas.conform(outcomes.where(F.col("result") == "Ok"), schemas.INCOMING)


def rejected(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("result") != "Ok").select("value", "error", "message")


def parse_events(lines: DataFrame, domains: DataFrame, edges: DataFrame, salts: DataFrame,
                 **options) -> DataFrame:
    """Cleaned events of the accepted lines (51 columns)."""
    return accepted(parse_outcomes(lines, domains, edges, salts, **options))


def drop_robots_and_local(events: DataFrame, agent: Column | None = None,
                          extra: Sequence[Column] = ()) -> DataFrame:
    """The tracker's own rules: no bots, no localhost, no local files.

    ``extra`` takes further exclusions, such as a prerender flag.
    """
    bot = F.col("request_is_bot") == 1 if agent is None else agents.is_bot(agent) == 1
    out = bot | (F.col("domain_name") == "localhost") | F.col("request_url").startswith("file:")
    for rule in extra:
        out = out | rule
    return events.where(~F.coalesce(out, F.lit(False)))

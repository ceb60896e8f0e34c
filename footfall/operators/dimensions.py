"""Joins against small user-supplied tables.

A table is broadcast only if the planner's size of it is within a bound; no job runs for that. Beyond the
bound the same join runs shuffled, and adaptive execution splits hot keys. Salts are broadcast in any case.
Repeated keys are folded by rules that do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20

# Country name as the edge table spells it -> ISO code.
COUNTRY_CODES = {
    "United States": "us", "Mexico": "mx", "Canada": "ca", "Germany": "de", "France": "fr",
    "Italy": "it", "Netherlands": "nl", "UK": "gb", "Ireland": "ie", "Austria": "at",
    "Sweden": "se", "Denmark": "dk", "Finland": "fi", "Greece": "gr", "Belgium": "be",
    "Hungary": "hu", "Portugal": "pt", "Norway": "no", "Romania": "ro", "Czech Republic": "cz",
    "Bulgaria": "bg", "Poland": "pl", "Croatia": "hr", "Switzerland": "ch", "Spain": "es",
    "India": "in", "Singapore": "sg", "Japan": "jp", "Taiwan": "tw", "Korea": "kr",
    "Thailand": "th", "Indonesia": "id", "Malaysia": "my", "Philippines": "ph", "Vietnam": "vn",
    "Australia": "au", "New Zealand": "nz", "Brazil": "br", "Colombia": "co", "Argentina": "ar",
    "Chile": "cl", "Peru": "pe", "Israel": "il", "Bahrain": "bh", "UAE": "ae",
    "Oman": "om", "South Africa": "za", "Kenya": "ke", "Nigeria": "ng", "China": "cn",
}


def broadcast_if_small(dim: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the planner's estimate of the table's size is at most ``max_bytes``."""
    size = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(dim) if size <= max_bytes else dim


def one_per_key(dim: DataFrame, *keys: str) -> DataFrame:
    """One row per key: of several, the least by its other columns in their order (NULL first)."""
    rest = [c for c in dim.columns if c not in keys]
    return dim.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")


def verified(events: DataFrame, domains: DataFrame) -> DataFrame:
    """Events whose domain and key are both registered together."""
    return events.join(_registered(domains), ["domain_name", "domain_key"], "left_semi")


def unverified(events: DataFrame, domains: DataFrame) -> DataFrame:
    """Events that ``verified`` leaves out, with the reason."""
    return events.join(_registered(domains), ["domain_name", "domain_key"], "left_anti").withColumn(
        "error", unverified_message(F.col("domain_name"), F.col("domain_key")))


def unverified_message(domain, key):
    shown = [F.coalesce(c, F.lit("null")) for c in (domain, key)]
    return F.format_string("Couldn't verify '%s' with domain key '%s'!", *shown)


def mark_verified(events: DataFrame, domains: DataFrame, flag: str = "is_verified") -> DataFrame:
    """All events, with a flag telling whether domain and key are registered."""
    known = _registered(domains).withColumn(flag, F.lit(True))
    joined = events.join(known, ["domain_name", "domain_key"], "left")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def _registered(domains: DataFrame) -> DataFrame:
    return broadcast_if_small(domains.select("domain_name", "domain_key").distinct())


def with_location(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Add city, state, country, code and coordinates of the edge; NULL if unknown."""
    columns = ["city", "state", "country", "country_code", "latitude", "longitude"]
    places = one_per_key(edges.select("edge_id", *columns), "edge_id").select(
        "edge_id",
        F.col("city").alias("edge_city"), F.col("state").alias("edge_state"),
        F.col("country").alias("edge_country"), F.col("country_code").alias("edge_country_code"),
        F.col("latitude").cast("float").alias("edge_latitude"),
        F.col("longitude").cast("float").alias("edge_longitude"))
    return events.join(broadcast_if_small(places), "edge_id", "left")


def with_salt(events: DataFrame, salts: DataFrame) -> DataFrame:
    """Add the salt of the event's date; NULL when no salt is kept for it, or several.

    Two salts of one date would give a visitor two ids, so such a date has none and its lines are rejected.
    There is one row per calendar date however large the table they come from, so they are broadcast: dealt by date, all lines
    without one would meet in one task, and so would the lines of a day.
    """
    daily = salts.groupBy("event_date").agg(F.min("salt").alias("salt"), F.max("salt").alias("_other"))
    daily = daily.select("event_date", F.when(F.col("salt") == F.col("_other"), F.col("salt")).alias("salt"))
    return events.join(F.broadcast(daily), "event_date", "left")


def countries(spark: SparkSession) -> DataFrame:
    """The built-in country dimension (50 rows)."""
    return spark.createDataFrame(list(COUNTRY_CODES.items()), "country string, country_code string")


def with_country_code(df: DataFrame, dim: DataFrame, country: str = "edge_country") -> DataFrame:
    """Add the ISO code of a country name."""
    names = dim.groupBy(F.col("country").alias(country)).agg(F.min("country_code").alias("country_code"))
    return df.join(broadcast_if_small(names), country, "left")


def with_country_name(df: DataFrame, dim: DataFrame, code: str = "country_code") -> DataFrame:
    """Add the country name of an ISO code."""
    codes = dim.groupBy(F.col("country_code").alias(code)).agg(F.min("country").alias("country"))
    return df.join(broadcast_if_small(codes), code, "left")

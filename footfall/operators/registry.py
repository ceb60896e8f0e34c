"""The registry of tracked domains, as changes from table to table."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["domain_name", "domain_key", "created_timestamp"]


def list_domains(domains: DataFrame, oldest_first: bool = False) -> DataFrame:
    """All domains by name (descending) or by age."""
    order = [F.asc("created_timestamp"), F.asc("domain_name")] if oldest_first else [F.desc("domain_name")]
    return domains.select(*COLUMNS).orderBy(*order)


def get_domain(domains: DataFrame, name: str) -> DataFrame:
    return domains.select(*COLUMNS).where(F.col("domain_name") == name)


def new_keys(names: DataFrame, created, seed: str | None = None) -> DataFrame:
    """Registry rows with fresh keys for a column ``domain_name``.

    The random part is drawn once, so recomputing the table gives the same keys.
    """
    salt = seed if seed is not None else secrets.token_hex(16)
    key = F.substring(F.sha2(F.concat_ws("|", F.lit(salt), "domain_name"), 256), 1, 16)
    stamp = created if not isinstance(created, str) else F.lit(created)
    return names.select("domain_name").distinct().select(
        "domain_name", key.alias("domain_key"), stamp.cast("timestamp").alias("created_timestamp"))


def upsert(domains: DataFrame, changes: DataFrame) -> DataFrame:
    """Put rows: a domain present in both takes the new row.

    Of several changes of a domain the newest counts, of equally new ones the one with the largest key.
    """
    newest = changes.groupBy("domain_name").agg(F.max(F.struct("created_timestamp", "domain_key")).alias("_row")).select(
        "domain_name", "_row.domain_key", "_row.created_timestamp")
    kept = domains.select(*COLUMNS).join(newest.select("domain_name"), "domain_name", "left_anti")
    return kept.unionByName(newest)


def delete(domains: DataFrame, names: DataFrame) -> DataFrame:
    return domains.select(*COLUMNS).join(names.select("domain_name"), "domain_name", "left_anti")

"""User-agent classification from ordered rule tables.

A rule is ``(token, pattern, name)``. The cheap ``contains(token)`` test decides
which rule applies; the pattern runs only for that rule. The tables below are a
small default set; callers pass their own for finer results.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    token: str
    pattern: str  # group 1 is the version; '' when the rule has none
    name: str


BROWSERS: tuple[Rule, ...] = (
    Rule("Edg", r"Edg(?:e|A|iOS)?/([\d.]+)", "Edge"),
    Rule("OPR/", r"OPR/([\d.]+)", "Opera"),
    Rule("SamsungBrowser/", r"SamsungBrowser/([\d.]+)", "Samsung Internet"),
    Rule("Firefox/", r"Firefox/([\d.]+)", "Firefox"),
    Rule("FxiOS/", r"FxiOS/([\d.]+)", "Firefox"),
    Rule("CriOS/", r"CriOS/([\d.]+)", "Chrome"),
    Rule("Chrome/", r"Chrome/([\d.]+)", "Chrome"),
    Rule("Mobile/", r"Version/([\d.]+)", "Mobile Safari"),
    Rule("Safari/", r"Version/([\d.]+)", "Safari"),
)

SYSTEMS: tuple[Rule, ...] = (
    Rule("Windows NT", r"Windows NT ([\d.]+)", "Windows"),
    Rule("iPhone OS", r"iPhone OS ([\d_]+)", "iOS"),
    Rule("iPad", r"CPU OS ([\d_]+)", "iOS"),
    Rule("Android", r"Android ([\d.]+)", "Android"),
    Rule("Mac OS X", r"Mac OS X ([\d_.]+)", "Mac OS"),
    Rule("CrOS", r"CrOS \S+ ([\d.]+)", "Chromium OS"),
    Rule("Linux", "", "Linux"),
)

# Windows reports its kernel version.
WINDOWS_VERSIONS = {"10.0": "10", "6.3": "8.1", "6.2": "8", "6.1": "7", "6.0": "Vista"}

DEVICE_KINDS: tuple[Rule, ...] = (
    Rule("PlayStation", "", "console"),
    Rule("Xbox", "", "console"),
    Rule("SmartTV", "", "smarttv"),
    Rule("SMART-TV", "", "smarttv"),
    Rule("iPad", "", "tablet"),
    Rule("iPhone", "", "mobile"),
    Rule("Tablet", "", "tablet"),
    Rule("Mobile", "", "mobile"),
    Rule("Android", "", "tablet"),
)

VENDORS: tuple[Rule, ...] = (
    Rule("Macintosh", "", "Apple"),
    Rule("iPhone", "", "Apple"),
    Rule("iPad", "", "Apple"),
    Rule("SM-", "", "Samsung"),
    Rule("SAMSUNG", "", "Samsung"),
    Rule("Pixel", "", "Google"),
    Rule("HUAWEI", "", "Huawei"),
    Rule("PlayStation", "", "Sony"),
    Rule("Xbox", "", "Microsoft"),
)

# Device type as classified -> device type as stored.
DEVICE_TYPES = {
    "console": "Console",
    "mobile": "Mobile",
    "tablet": "Tablet",
    "smarttv": "SmartTV",
    "wearable": "Wearable",
    "embedded": "Embedded",
}

BOT_WORDS = ("bot", "spider", "crawl")


class Rules(NamedTuple):
    """All rule tables of the parser; callers replace those they have better ones for."""

    browsers: Sequence[Rule] = BROWSERS
    systems: Sequence[Rule] = SYSTEMS
    device_kinds: Sequence[Rule] = DEVICE_KINDS
    vendors: Sequence[Rule] = VENDORS
    bot_words: Sequence[str] = BOT_WORDS


def match(agent: Column, rules: Sequence[Rule]) -> Column:
    """Position of the first rule whose token occurs in the agent text, or NULL."""
    return F.coalesce(F.lit(None).cast("int"), *(F.when(agent.contains(r.token), F.lit(n)) for n, r in enumerate(rules)))


def name(matched: Column, rules: Sequence[Rule]) -> Column:
    """Name of a matched rule."""
    return F.get(F.array(*(F.lit(r.name) for r in rules)).cast("array<string>"), matched)


def version(agent: Column, matched: Column, rules: Sequence[Rule]) -> Column:
    """Version captured by a matched rule; NULL without one."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for n, r in enumerate(rules):
        if r.pattern:
            chain = chain.when(matched == n, F.regexp_extract(agent, r.pattern, 1))
    return F.nullif(chain, F.lit(""))


def dotted(found: Column, system: Column) -> Column:
    """A system's version with dots, and with Windows kernel versions translated."""
    found = F.translate(found, "_", ".")
    windows = F.create_map(*(F.lit(x) for pair in WINDOWS_VERSIONS.items() for x in pair))
    return F.when(system == "Windows", F.coalesce(windows[found], found)).otherwise(found)


def system_version(agent: Column, matched: Column, rules: Sequence[Rule] = SYSTEMS) -> Column:
    """Operating system version, dotted, with Windows kernel versions translated."""
    return dotted(version(agent, matched, rules), name(matched, rules))


def device_type(kind: Column) -> Column:
    """Stored device type; unknown and missing kinds count as Desktop."""
    known = F.create_map(*(F.lit(x) for pair in DEVICE_TYPES.items() for x in pair))
    return F.coalesce(known[kind], F.lit("Desktop"))


def is_bot(agent: Column, words: Sequence[str] = BOT_WORDS) -> Column:
    """1 when one of the words occurs in the agent text, in any case."""
    text = F.lower(agent)
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word.lower())
    return F.coalesce(found, F.lit(False)).cast("int")

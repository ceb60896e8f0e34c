"""Percent decoding, query strings and URL parts as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme, optional user info, then the host (a bracketed address or a name).
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
# A web address needs a host; any other scheme is taken as it is.
_ABSOLUTE = r"^(?:[Hh][Tt][Tt][Pp][Ss]?://[^/?#\s]|(?![Hh][Tt][Tt][Pp][Ss]?:)[A-Za-z][A-Za-z0-9+.\-]*:)"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def form_decode(c: Column) -> Column:
    """Decode a form-encoded value (``+`` is a space); NULL when malformed."""
    return F.try_url_decode(c)


def percent_decode(c: Column) -> Column:
    """Decode percent escapes only (``+`` stays); NULL when malformed or when the bytes are no UTF-8.

    Such bytes decode to the replacement character, so a text that holds that character itself counts as malformed.
    """
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(~decoded.contains("\ufffd"), decoded)


def param_keys(query: Column) -> Column:
    """Decoded keys of a query string, in order of appearance; a key that cannot be decoded is left as it is."""

    def key(pair: Column) -> Column:
        raw = F.substring_index(pair, "=", 1)
        return F.when(raw.contains("%") | raw.contains("+"), F.coalesce(form_decode(raw), raw)).otherwise(raw)

    return F.transform(F.split(query, "&"), key)


def param_values(query: Column) -> Column:
    """Raw values matching ``param_keys``; a key without ``=`` has the value ''."""
    return F.transform(
        F.split(query, "&"),
        lambda p: F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p))).otherwise(""),
    )


def pick_param(keys: Column, values: Column, key: str) -> Column:
    """Raw value of the first occurrence of ``key``; NULL when absent or empty."""
    return F.nullif(F.get(values, (F.array_position(keys, F.lit(key)) - 1).cast("int")), F.lit(""))


def decode_param(raw: Column) -> Column:
    """Values are encoded twice: once by the client's form, once by the browser."""
    return percent_decode(form_decode(raw))


def query_param(query: Column, key: str) -> Column:
    """One decoded parameter of a query string (first occurrence wins)."""
    return decode_param(pick_param(param_keys(query), param_values(query), key))


def url_host(url: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(url, _HOST, 1)))


def url_path(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, _PATH, 1))


def url_query(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, _QUERY, 1))


def is_absolute_url(url: Column) -> Column:
    return url.rlike(_ABSOLUTE)


def leading_int(c: Column, kind: str = "bigint") -> Column:
    """The whole number a text starts with; NULL when there is none.

    Plain numbers are cast directly; the pattern is only tried on the rest.
    """
    plain = F.substring_index(c, ".", 1).try_cast(kind)
    return F.coalesce(plain, F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast(kind))


def leading_number(c: Column) -> Column:
    """The decimal number a text starts with; NULL when there is none."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")

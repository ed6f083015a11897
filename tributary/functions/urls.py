"""Addresses of services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_USER = r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#@]*)@"


def _schemed(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def normalize(url: Column) -> Column:
    """http:// in front of an address without a scheme."""
    return F.when(_schemed(url), url).otherwise(F.concat(F.lit("http://"), url))


def ensure_https(url: Column) -> Column:
    """https:// in front of an address without a scheme; else the first http:// becomes https://."""
    at = F.instr(url, "http://")
    swapped = F.when(at > 0, F.concat(F.substr(url, F.lit(1), at - 1), F.lit("https://"), F.substr(url, at + 7))).otherwise(url)
    return F.when(_schemed(url), swapped).otherwise(F.concat(F.lit("https://"), url))


def is_https(url: Column) -> Column:
    return url.startswith("https://")


def add_basic_auth(url: Column, user: str, password: str) -> Column:
    """url with user and password; as it is for an empty user; an error where it names a user already."""
    if not user:
        return url
    from urllib.parse import quote

    held = F.regexp_extract(url, _USER, 2)
    added = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", f"$1{quote(user, safe='')}:{quote(password, safe='')}@".replace("\\", ""))
    return F.when(F.regexp_extract(held, "^([^:]*)", 1) != "", F.raise_error(F.lit("url names a user already"))).otherwise(added)


def redact(url: Column) -> Column:
    """url with xxxxx for a password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#@:]*):[^/?#@]*@", "$1:xxxxx@")

"""Which headlines announce a routine release, as column expressions.

The patterns are fixed values: they decide which stored records a reader sees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_.+-]"
#: A bare version tag: major, minor, patch, suffix.
VERSION = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?([-+][\p{L}\p{N}_.-]+)?$"
#: A product name (optional) before a dotted version, and a suffix.
FEED_TAG = rf"^(?:({_W}+(?:\s+{_W}+)*)\s+)?v?(\d+(?:\.\d+)+)([-+][\p{{L}}\p{{N}}_.-]+)?$"
PULL_REQUEST = r"\(#\d+\)"
PINNED = r"^[\p{L}\p{N}_.-]+==\d+(?:\.\d+)+(?:[-+][\p{L}\p{N}_.-]+)?$"
BUILD = r"^(?:b\d{4,}|build[ -]?\d{3,})(?:[^\p{L}\p{N}_]|$)"


def routine_version(title: Column) -> Column:
    """A bare tag that is a pre-release, below 1.0, or a patch."""
    low = F.lower(title)
    part = lambda n: F.regexp_extract(low, VERSION, n)
    return low.rlike(VERSION) & ((part(4) != "") | (part(1) == "0") | ((part(3) != "") & (part(3) != "0")))


def routine_feed_tag(title: Column) -> Column:
    """A dotted tag, perhaps behind a product's name: a pre-release, below 1.0, or three parts and more with a last one that isn't 0."""
    low = F.lower(F.trim(title))
    version = F.split(F.regexp_extract(low, FEED_TAG, 2), r"\.")
    patch = (F.size(version) >= 3) & (F.element_at(version, -1) != "0")
    return low.rlike(FEED_TAG) & ((F.regexp_extract(low, FEED_TAG, 3) != "") | (version[0] == "0") | patch)


def bare_build(title: Column) -> Column:
    return F.lower(F.trim(title)).rlike(BUILD)


def routine_release(title: Column, from_release_feed: Column) -> Column:
    """Any sign of a routine release; a product's name before the tag counts only in a release feed."""
    t = F.trim(title)
    return F.coalesce((F.coalesce(from_release_feed, F.lit(False)) & routine_feed_tag(t)) | t.rlike(PULL_REQUEST) | routine_version(t) | F.lower(t).rlike(PINNED) | bare_build(t), F.lit(False))


def purge_reason(title: Column, source: Column, from_release_feed: Column, level: Column) -> Column:
    """Why a record leaves the archive; null if it stays."""
    named = F.coalesce(F.endswith(source, F.lit("Releases")), F.lit(False)) & F.coalesce(routine_feed_tag(title), F.lit(False))
    return F.when(level == 1, "importance-1").when(routine_release(title, from_release_feed) | named, "routine-release")


# the same rules in SQL, for the checks; T stands for the headline, F for the flag of a release feed
_LOW = "lower(trim(T))"
SQL_VERSION = f"(regexp_matches({_LOW}, '{VERSION}') and (regexp_extract({_LOW}, '{VERSION}', 4) <> '' or regexp_extract({_LOW}, '{VERSION}', 1) = '0' or regexp_extract({_LOW}, '{VERSION}', 3) not in ('', '0')))"
_PARTS = f"string_split(regexp_extract({_LOW}, '{FEED_TAG}', 2), '.')"
SQL_FEED_TAG = f"(regexp_matches({_LOW}, '{FEED_TAG}') and (regexp_extract({_LOW}, '{FEED_TAG}', 3) <> '' or {_PARTS}[1] = '0' or (len({_PARTS}) >= 3 and {_PARTS}[-1] <> '0')))"
SQL_BUILD = f"regexp_matches({_LOW}, '{BUILD}')"
SQL_RELEASE = f"coalesce((coalesce(F, false) and {SQL_FEED_TAG}) or regexp_matches(T, '{PULL_REQUEST}') or {SQL_VERSION} or regexp_matches({_LOW}, '{PINNED}') or {SQL_BUILD}, false)"


def in_sql(rule: str, title: str, flag: str = "false") -> str:
    return rule.replace("(F, ", f"({flag}, ").replace("(T", f"({title}")

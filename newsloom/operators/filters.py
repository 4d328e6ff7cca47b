"""Filters and lookups of the archive with their vocabulary as parameters; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(parts: list[Column]) -> Column:
    """Whether any holds; nothing asked is false. Nulls count as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(False))


def from_community(source: Column, domain: Column, hints: list[str]) -> Column:
    """Whether source or domain holds one of the hints, in any case."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(source, F.lit("")), F.coalesce(domain, F.lit(""))))
    return any_of([F.contains(hay, F.lit(h.lower())) for h in hints])


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "(?i)^https?://(?:[^/@]*@)?([^/?#:]+)", 1)), r"\.+$", "")


def under(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or lies below one."""
    return any_of([(host == d.lower()) | F.endswith(host, F.lit(f".{d.lower()}")) for d in domains])


def allowed(url: Column, allow: list[str], skip: list[str]) -> Column:
    """A web address that holds one of ``allow`` (any, if there are none) and none of ``skip``."""
    low = F.lower(url)
    kept = any_of([F.contains(low, F.lit(a.lower())) for a in allow]) if allow else F.lit(True)
    return F.coalesce(low.rlike("^https?://"), F.lit(False)) & kept & ~any_of([F.contains(low, F.lit(s.lower())) for s in skip])


def feed(rows: DataFrame, level: Column, categories: list[str] | None = None, sources: list[str] | None = None, least_level: int = 0, words: str = "", days: tuple[str, str] | None = None, text: list[str] | None = None) -> DataFrame:
    """The rows a reader asks for; a part that isn't asked for keeps everything. All words of a query must occur."""
    out = rows.where(level >= least_level) if least_level else rows
    if categories is not None:
        out = out.where(F.col("category").isin(*categories))
    if sources is not None:
        out = out.where(F.col("source").isin(*sources))
    if days:
        out = out.where(F.col("day").between(*days))
    everything = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text or ["title", "summary", "source"]]))
    for w in words.lower().split():
        out = out.where(F.contains(everything, F.lit(w)))
    return out


def day_lookup(rows: DataFrame, day: str, key: str) -> DataFrame:
    """The rows of a day whose key no other row of the day has."""
    mine = rows.where(F.col("day") == day)
    return mine.join(mine.groupBy(key).count().where("count = 1").select(key), key, "left_semi")


def only(values: Column, allowed_: list[str]) -> Column:
    """Whether an array holds nothing but the allowed values; an empty one does."""
    return F.forall(values, lambda x: x.isin(*allowed_))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Terms of a text with the position of their first occurrence (from 1), in order: each once, a term that lies within a
    longer one at that place left out, ties to the longer one."""
    low = F.lower(text)
    at = F.filter(F.array(*[F.struct(F.instr(low, t.lower()).alias("at"), F.lit(len(t)).alias("size"), F.lit(t).alias("term")) for t in sorted(set(terms))]), lambda x: x["at"] > 0)
    inside = lambda x: F.exists(at, lambda y: (y["size"] > x["size"]) & (y["at"] <= x["at"]) & (y["at"] + y["size"] >= x["at"] + x["size"]))
    return F.array_sort(F.filter(at, lambda x: ~inside(x)))

"""Scalar text functions of the archive as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules


def normalized_title(title: Column) -> Column:
    """Folded case (ß as ss), without a trailing `` - Publisher``, word characters only: the key of a headline."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(title), F.lit("ß"), F.lit("ss")), r"\s+-\s+[^-]{2,40}$", ""), r"[^\p{L}\p{N}_]+", "")


def item_id(title: Column) -> Column:
    """The first twelve hex digits of the SHA-1 of the headline's key."""
    return F.substring(F.sha1(normalized_title(title)), 1, 12)


def shorten(title: Column, limit: int = 120) -> Column:
    """A headline of at most ``limit`` characters and an ellipsis, cut at a blank past the middle."""
    text = F.trim(title)
    head = F.substring(text, 1, limit)
    cut = F.length(head) - F.instr(F.reverse(head), " ")
    kept = F.when((F.instr(head, " ") > 0) & (cut >= limit // 2), F.expr("1")).otherwise(F.lit(0))
    short = F.when(kept == 1, F.substring(head, F.lit(1), cut)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(short, F.lit(" ,.;:!?-–—")), F.lit("…")))


def compact(value: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "[\\s\u00a0\u3000]+", " ")), 1, limit)


def visible_length(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"\s+", ""))


def keyword_hits(text: Column, words: list[str], lowered: bool = False) -> Column:
    """How many of the words a text holds, in any case; a text that is lower case already need not be folded for each word."""
    low = text if lowered else F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def classify(text: Column, hint: Column, lowered: bool = False) -> Column:
    """The category with most keywords; a hint counts one; ties go in the order agent, benchmark, release, industry."""
    order = ["agent", "benchmark", "release", "industry"]
    score = {c: keyword_hits(text, rules.CATEGORY_KEYWORDS[c], lowered) + F.coalesce((hint == c).cast("int"), F.lit(0)) for c in order}
    best = F.greatest(*score.values())
    pick = F.coalesce(*[F.when(score[c] == best, F.lit(c)) for c in order])
    return F.when(best == 0, F.coalesce(hint, F.lit("industry"))).otherwise(pick)


def with_category(df: DataFrame, low: str, hint: str, name: str = "category") -> DataFrame:
    """``df`` with the category of the lower-case text in column ``low`` (as ``classify``), keywords counted once a row."""
    order = ["agent", "benchmark", "release", "industry"]
    df = df.withColumns({f"_n_{c}": keyword_hits(F.col(low), rules.CATEGORY_KEYWORDS[c], True) + F.coalesce((F.col(hint) == c).cast("int"), F.lit(0)) for c in order})
    df = df.withColumn("_most", F.greatest(*[f"_n_{c}" for c in order]))
    pick = F.coalesce(*[F.when(F.col(f"_n_{c}") == F.col("_most"), F.lit(c)) for c in order])
    return df.withColumn(name, F.when(F.col("_most") == 0, F.coalesce(F.col(hint), F.lit("industry"))).otherwise(pick)).drop("_most", *[f"_n_{c}" for c in order])


def tags(text: Column, category: Column, lowered: bool = False) -> Column:
    """Labels of the rule table that a text matches, the category's own label last, five at most."""
    low = text if lowered else F.lower(text)
    labels = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in rules.TAG_PATTERNS.items()]))
    own = F.create_map(*[F.lit(x) for kv in rules.CATEGORY_TAG.items() for x in kv])[category]
    return F.slice(F.when(F.array_contains(labels, own), labels).otherwise(F.concat(labels, F.array(own))), 1, 5)


def rule_score(hours: Column, official: Column, n_tags: Column, text: Column) -> Column:
    recency = F.greatest(F.lit(0), F.lit(18) - F.floor(F.greatest(hours, F.lit(0.0)) / 8))
    words = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in rules.SIGNAL_WORDS])
    total = F.lit(48) + recency + F.when(official, 18).otherwise(0) + F.least(F.lit(14), (n_tags - 1) * 4) + F.when(words, 6).otherwise(0)
    return F.least(F.lit(100), total).cast("int")


def signal(score: Column) -> Column:
    return F.when(score >= 82, "high").when(score >= 68, "medium").otherwise("normal")


def level(score: Column) -> Column:
    out = None
    for least, value in rules.LEVEL_STEPS:
        out = F.when(score >= least, value) if out is None else out.when(score >= least, value)
    return out.otherwise(1)


def redact(text: Column) -> Column:
    for pattern, label in rules.SECRETS:
        text = F.regexp_replace(text, pattern, label)
    return text


def limit_lines(body: Column, limit: int) -> Column:
    """As many whole lines as fit into ``limit`` characters; a code fence left open is closed. Null stays null."""
    plain = F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), r"^\s+|\s+$", "")
    lines = F.split(plain, "\n")
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"), F.lit(False).alias("code"))

    def take(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.length(line) + 1
        full = acc["full"] | (used > limit)
        fence = F.ltrim(line).startswith("```")
        return F.struct(
            F.when(full, acc["used"]).otherwise(used).alias("used"), F.when(full, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"), full.alias("full"), F.when(full, acc["code"]).otherwise(acc["code"] != fence).alias("code")
        )

    got = F.aggregate(lines, start, take)
    cut = F.concat(F.array_join(F.when(got["kept"] > 0, F.slice(lines, F.lit(1), got["kept"])).otherwise(F.array().cast("array<string>")), "\n"), F.when(got["code"], "\n```").otherwise(""))
    return F.when(plain.isNull() | (F.length(plain) <= limit), plain).otherwise(F.regexp_replace(cut, r"^\s+|\s+$", ""))


def community(source: Column, domain: Column) -> Column:
    """Whether a record comes from a forum."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(source, F.lit("")), F.coalesce(domain, F.lit(""))))
    return reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w)) for w in rules.COMMUNITY])


def han(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def latin(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def cap_to(dims: list[Column], ceiling: Column) -> list[Column]:
    """Integers scaled down to sum to ``ceiling``: floors, and the rest by one in the given order to those that shrank."""
    total = reduce(lambda a, b: a + b, dims)
    low = [F.floor(d * ceiling / total).cast("int") for d in dims]
    rest = ceiling - reduce(lambda a, b: a + b, low)
    out, used = [], F.lit(0)
    for d, x in zip(dims, low):
        shrank = (x < d).cast("int")
        used = used + shrank
        out.append(x + F.when((shrank == 1) & (used <= rest), 1).otherwise(0))
    return [F.when((total <= ceiling) | (total == 0), d).otherwise(o).cast("int") for d, o in zip(dims, out)]


def human_bytes(n: Column) -> Column:
    out = None
    for unit, scale in (("GiB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        text = F.concat(F.format_number(n / scale, 1), F.lit(f" {unit}"))
        out = F.when(F.abs(n) >= scale, text) if out is None else out.when(F.abs(n) >= scale, text)
    return F.when(n.isNull(), "—").otherwise(out.otherwise(F.concat(F.format_number(n, 0), F.lit(" B"))))

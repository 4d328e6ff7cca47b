"""Reviews of records as column expressions: checked values, ceilings, levels, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules, text


def clamped(dims: dict[str, Column]) -> list[Column]:
    """Points per dimension, 0 where there are none, within each dimension's limit."""
    return [F.least(F.lit(most), F.greatest(F.lit(0), F.coalesce(dims[name], F.lit(0)))) for name, most in rules.DIMENSION_LIMITS.items()]


def one_of(value: Column, allowed: list[str], other: str) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*allowed), low).otherwise(other)


def ceiling(relevant: Column, information: Column, evidence: Column, impact: Column, from_forum: Column, routine: Column) -> Column:
    """The most points a review may have: the least of the limits that apply."""
    limits = [(~F.coalesce(relevant, F.lit(False)), 29), (information == "rehash", 49), (information == "rumor", 69), ((impact < 20) | (evidence != "clear"), 84), (from_forum & (evidence != "clear"), 59), (routine, 49)]
    return F.least(F.lit(100), *[F.when(c, most).otherwise(100) for c, most in limits])


def review(df: DataFrame, keep: list[str], dims: dict[str, Column], relevant: Column, information: Column, evidence: Column, from_forum: Column, routine: Column) -> DataFrame:
    """``keep`` and the checked fields of a review: dimensions capped to the ceiling, score, level, evidence, information.

    Each step is a projection of its own, so that no rule is worked out more than once a row.
    """
    names = list(rules.DIMENSION_LIMITS)
    read = df.select(
        *keep, *[c.alias(n) for n, c in zip(names, clamped(dims))], one_of(information, rules.INFORMATION, "analysis").alias("information"), one_of(evidence, rules.EVIDENCE, "partial").alias("evidence"),
        relevant.alias("_relevant"), from_forum.alias("_forum"), routine.alias("_routine"),
    )
    limited = read.withColumn("_most", ceiling(F.col("_relevant"), F.col("information"), F.col("evidence"), F.col("impact"), F.col("_forum"), F.col("_routine")))
    return capped(limited, keep, "_most").withColumn("level", text.level(F.col("score"))).select(*keep, *names, "score", "level", "evidence", "information")


def capped(df: DataFrame, keep: list[str], most: str) -> DataFrame:
    """``df`` with its dimensions scaled down to sum to the column ``most`` (as ``text.cap_to``, in steps), and their ``score``."""
    names = list(rules.DIMENSION_LIMITS)
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    df = df.withColumn("_total", total)
    df = df.withColumns({f"_low_{n}": F.floor(F.col(n) * F.col(most) / F.col("_total")).cast("int") for n in names})
    df = df.withColumn("_rest", F.col(most) - reduce(lambda a, b: a + b, [F.col(f"_low_{n}") for n in names]))
    df = df.withColumns({f"_shrank_{n}": (F.col(f"_low_{n}") < F.col(n)).cast("int") for n in names})
    steps, used = {}, F.lit(0)
    for n in names:
        used = used + F.col(f"_shrank_{n}")
        steps[n] = F.when((F.col("_total") <= F.col(most)) | (F.col("_total") == 0), F.col(n)).otherwise(F.col(f"_low_{n}") + F.when((F.col(f"_shrank_{n}") == 1) & (used <= F.col("_rest")), 1).otherwise(0)).cast("int")
    return df.withColumns(steps).withColumn("score", total)


def long_summary(summary: Column, title: Column, source: Column, original: Column, reason: Column, level: Column) -> Column:
    """A summary of an important record that is too short is filled up with what the record says of itself."""
    strip = lambda c: F.rtrim(c, F.lit("。； "))
    some = F.coalesce(summary, F.lit(""))
    own = text.compact(original, 360)
    why = F.coalesce(reason, F.lit(""))
    where = text.compact(source, 60)
    parts = F.array_compact(
        F.array(
            F.when(strip(some) != "", strip(some)),
            F.when((own != "") & ~F.contains(some, own), F.concat(F.lit("原始信息显示："), strip(own))),
            F.concat(F.lit("该消息由"), F.when(where != "", where).otherwise("原始信息源"), F.lit("发布，主题为“"), text.compact(title, 180), F.lit("”")),
            F.when((why != "") & ~F.contains(some, why), F.concat(F.lit("其重要性主要体现在："), strip(why))),
            F.lit("建议结合原文核对关键数据、适用条件、技术限制与后续更新，以判断其对实际产品和研发决策的影响"),
        )
    )
    long = text.compact(F.concat(F.array_join(parts, "。"), F.lit("。")), 700)
    return F.when((level < 4) | (text.visible_length(some) >= 100), some).otherwise(long)


def glossary(entries: Column, level: Column, most: int = 8) -> Column:
    """Terms with an explanation (array of term, explanationZh): a Latin term, a Chinese explanation, each term once by its
    folded form, the first ``most``; none for records of low level. Null is none."""
    named = F.transform(F.coalesce(entries, F.array().cast("array<struct<term:string,explanationZh:string>>")), lambda e: F.struct(text.compact(e["term"], 60).alias("term"), text.compact(e["explanationZh"], 180).alias("explanationZh")))
    valid = F.filter(named, lambda e: e["term"].rlike("[A-Za-z]") & e["explanationZh"].rlike("[一-鿿]"))
    terms = F.transform(valid, lambda e: F.lower(e["term"]))
    first = F.filter(valid, lambda e, i: F.array_position(terms, F.lower(e["term"])) == i + 1)
    return F.when(level >= 4, F.slice(first, 1, most)).otherwise(F.array().cast("array<struct<term:string,explanationZh:string>>"))


def review_tags(tags: Column, others: Column) -> Column:
    """Tags of a review, each once, five at most; the record's own where there are none."""
    clean = lambda c, least: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: text.compact(t, 24)), lambda t: F.length(t) > least))
    own = F.filter(F.transform(F.slice(F.coalesce(others, F.array().cast("array<string>")), 1, 5), lambda t: text.compact(t, 24)), lambda t: t != "")
    return F.slice(F.when(F.size(clean(tags, 1)) > 0, clean(tags, 1)).otherwise(own), 1, 5)

"""Relational operators of the archive: keyed upserts, first-wins choices, two-key lookups, streaks, rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key. Spark keeps only the leading row of each key before it shuffles."""
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def merge_newer(new: DataFrame, old: DataFrame, key: str, keep_old: list[str]) -> DataFrame:
    """Full outer merge on ``key``: the new row wins field by field, the fields in ``keep_old`` stay as they were."""
    n, o = new.alias("n"), old.alias("o")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep_old else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "full").select(*[pick(c).alias(c) for c in new.columns])


def lookup_two_keys(rows: DataFrame, history: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of history by ``first``, else by ``second`` (the smallest value where a key repeats)."""
    by_first = history.where(F.col(first).isNotNull()).groupBy(first).agg(F.min(value).alias("_a"))
    by_second = history.where(F.col(second).isNotNull()).groupBy(second).agg(F.min(value).alias("_b"))
    out = rows.join(by_first, first, "left").join(by_second, second, "left")
    return out.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def streaks(df: DataFrame, key: list[str], order: list[Column], bad: Column) -> DataFrame:
    """``df`` with ``streak``: how many bad rows in a row end at this one (gaps and islands)."""
    run = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = df.withColumn("_bad", bad.cast("int")).withColumn("_island", F.sum(1 - F.col("_bad")).over(run))
    within = Window.partitionBy(*key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.when(F.col("_bad") == 1, F.sum("_bad").over(within)).otherwise(0)).drop("_bad", "_island")


def rolling(df: DataFrame, key: list[str], seconds: Column, span: int, aggs: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over the rows of its key of the last ``span`` seconds, both ends included."""
    by = Window.partitionBy(*key).orderBy(seconds).rangeBetween(-span, 0)
    return df.withColumns({n: a.over(by) for n, a in aggs.items()})


def diff(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has: ``side`` is missing (only expected) or extra (only actual)."""
    gone = expected.select(*key).distinct().join(actual.select(*key).distinct(), key, "left_anti").withColumn("side", F.lit("missing"))
    more = actual.select(*key).distinct().join(expected.select(*key).distinct(), key, "left_anti").withColumn("side", F.lit("extra"))
    return gone.unionByName(more)

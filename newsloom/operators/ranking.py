"""Row numbers and carried values within groups of any size: no group is sorted by one task.

Rows are dealt by ranges of (group, order) into parts of bounded size and written once; each part works on its own, and a
small table of what the parts before it hold (rows, last values) puts them together. Nulls in a group column form a
group of their own. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize

#: Rows of one part.
PART = 500_000


def _parts(df: DataFrame, group: list[str], order: list[Column], rows: int) -> DataFrame:
    n = max(1, -(-df.count() // rows))
    key = F.concat_ws("\x1f", *[F.when(F.col(g).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(g).cast("string"))) for g in group])
    named = df.withColumn("_g", key)
    return materialize(named.repartitionByRange(n, "_g", *order).withColumn("_p", F.spark_partition_id()), "ranges")


def row_numbers(df: DataFrame, group: list[str], order: list[Column], name: str = "position", rows: int = PART) -> DataFrame:
    """``df`` with the number (from 1) of each row in its group, in ``order``, which should leave no ties."""
    parts = _parts(df, group, order, rows)
    counts = parts.groupBy("_g", "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_p").orderBy(*order)))
    out = join_small(local, offsets, ["_g", "_p"], "inner", 96)
    return out.select(*df.columns, (F.col("_before") + F.col("_r")).alias(name))


def last_before(df: DataFrame, group: list[str], order: list[Column], value: str, name: str, rows: int = PART) -> DataFrame:
    """``df`` with the last value that isn't null of the rows before each one in its group, in ``order``."""
    parts = _parts(df, group, order, rows)
    ends = parts.withColumn("_l", F.last(value, ignorenulls=True).over(Window.partitionBy("_g", "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.groupBy("_g", "_p").agg(F.first("_l").alias("_l"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_g", "_p", F.last("_l", ignorenulls=True).over(before).alias("_carried"))
    local = parts.withColumn("_own", F.last(value, ignorenulls=True).over(Window.partitionBy("_g", "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    out = join_small(local, carried, ["_g", "_p"], "inner", 512)
    return out.select(*df.columns, F.coalesce("_own", "_carried").alias(name))

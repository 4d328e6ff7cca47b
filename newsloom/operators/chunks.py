"""Greedy chunks of ordered rows: as many as fit a size and a count, an oversized row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(df: DataFrame, group: str, order: str, size: str, most_size: int, most_rows: int) -> DataFrame:
    """``group``, ``order`` and ``chunk_no`` (from 1). A fold in the JVM over the rows of a group, which must be of bounded size
    (the blocks of one text); null sizes count 0, empty tables give no rows."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("rows"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["rows"] == 0) | (a["rows"] >= most_rows) | (a["chars"] + x["s"] > most_size)
        n = a["n"] + full.cast("int")
        return F.struct(n.alias("n"), F.when(full, x["s"]).otherwise(a["chars"] + x["s"]).alias("chars"), F.when(full, 1).otherwise(a["rows"] + 1).alias("rows"), F.concat(a["out"], F.array(n)).alias("out"))

    told = df.groupBy(group).agg(rows.alias("r")).withColumn("c", F.aggregate("r", start, step)["out"])
    return told.select(group, F.explode(F.arrays_zip("r", "c")).alias("z")).select(group, F.col("z.r.o").alias(order), F.col("z.c").alias("chunk_no"))

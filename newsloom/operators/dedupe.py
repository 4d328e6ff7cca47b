"""Greedy choice over several keys: a row is taken unless a row taken before shares any of its keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialize

#: Undecided pairs of row and key from which on one task settles the rest in order, instead of another round.
FEW = 500_000


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settles at most ``FEW`` pairs (rank, ident, hub, taken) in the order of rank."""
    parts = [df for df in batches if len(df)]
    if not parts:
        return
    df = pd.concat(parts)
    taken = df["taken"].astype(bool)
    gone = set(df.loc[taken, "hub"])
    out = []
    for (_, ident), hubs in df[~taken].groupby(["rank", "_id"], sort=True)["hub"]:
        if gone.isdisjoint(hubs):
            gone.update(hubs)
            out.append(ident)
    yield pd.DataFrame({"_id": out})


def greedy_first(rows: DataFrame, keys: list[str], order: Column, ident: str) -> DataFrame:
    """The rows of ``rows`` that a loop in the order of ``order`` (a struct of longs, unique) takes.

    A null key is shared with no row, so a row without any key is always taken. Rows work in parallel rounds: what no
    undecided row before it shares a key with is taken, what shares one with a taken row is dropped. Keys are hubs, so
    rows never meet in pairs, and rows that share all keys are contracted first. No row is compared with itself: rows of
    one ``ident`` are one. An empty table stays empty.
    """
    spark = rows.sparkSession
    id_type = rows.schema[ident].dataType.simpleString()
    with Scratch(spark, "greedy") as scratch:
        hub = lambda i: F.when(F.col(keys[i]).isNotNull(), F.sha2(F.concat(F.lit(f"{i}:"), F.col(keys[i]).cast("string")), 256))
        named = rows.select(F.col(ident).alias("_id"), order.alias("rank"), F.array_compact(F.array(*[hub(i) for i in range(len(keys))])).alias("hubs"))
        free = named.where(F.size("hubs") == 0).select("_id")
        first = named.where(F.size("hubs") > 0).groupBy("hubs").agg(F.min(F.struct("rank", "_id")).alias("m"))
        edges = scratch.write(first.select("m.rank", "m._id", F.explode("hubs").alias("hub"), F.lit(False).alias("taken")))
        taken = [free]
        while edges.count() > FEW:
            least = edges.groupBy("hub").agg(F.min(F.when(~F.col("taken"), F.col("rank"))).alias("least"), F.max("taken").alias("gone"))
            told = edges.where("not taken").join(least, "hub").groupBy("_id").agg(F.max("gone").alias("gone"), F.min(F.col("least") == F.col("rank")).alias("won"))
            told = scratch.write(told)
            won = told.where("won and not gone").select("_id")
            taken.append(won)
            rest = scratch.write(edges.where("not taken").join(told.where("not gone and not won").select("_id"), "_id"))
            marks = edges.join(won, "_id").join(rest.select("hub").distinct(), "hub", "left_semi").select("rank", "_id", "hub", F.lit(True).alias("taken"))
            edges = scratch.write(rest.select("rank", "_id", "hub", "taken").unionByName(marks))
        taken.append(edges.select(_flat(edges), "_id", "hub", "taken").coalesce(1).mapInPandas(_in_order, f"_id {id_type}"))
        out = taken[0]
        for more in taken[1:]:
            out = out.unionByName(more)
        return rows.join(materialize(out, "taken").withColumnRenamed("_id", ident), ident, "left_semi")


def _flat(edges: DataFrame) -> Column:
    """A struct of longs as text that sorts alike: each field moved above 0 and padded."""
    fields = edges.schema["rank"].dataType.fieldNames()
    return F.concat_ws("", *[F.lpad((F.col(f"rank.{f}").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0") for f in fields]).alias("rank")

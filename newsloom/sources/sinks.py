"""Writing partitions that changed, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, exists


def changed_partitions(new: DataFrame, old: DataFrame | None, part: str, columns: list[str]) -> DataFrame:
    """Values of ``part`` whose rows differ, by count and an order-free hash of the rows."""
    finger = lambda df: df.groupBy(part).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("h"), F.sum(F.xxhash64(*columns) % 1_000_003).alias("s"))
    a = finger(new)
    if old is None:
        return a.select(part)
    b = finger(old).withColumnsRenamed({"n": "n0", "h": "h0", "s": "s0"})
    return a.join(b, part, "left").where(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("h").eqNullSafe(F.col("h0")) & F.col("s").eqNullSafe(F.col("s0")))).select(part)


def write_changed(new: DataFrame, path: str, part: str = "day") -> int:
    """Overwrites the partitions of ``path`` that changed; returns how many. The first write creates the table."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else None  # any other failure to read must not look like "no table"
    columns = [c for c in new.columns if c != part]
    parts = changed_partitions(new, old.select(*new.columns) if old is not None else None, part, columns).persist()
    n = parts.count()
    if n:
        new.join(parts, part, "left_semi").repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    parts.unpersist()
    return n


def write_index(rows: DataFrame, path: str) -> None:
    """A search index as compact JSON lines: null and empty fields are left out."""
    slim = rows.select(*[F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in rows.columns])
    slim.write.mode("overwrite").option("ignoreNullFields", True).option("compression", "none").json(path)


def unexpected(present: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Files that nothing expects. Refuses (raises) where nothing at all is expected, as that would be a broken plan."""
    if expected.isEmpty():
        raise ValueError("no file is expected: nothing is removed")
    return present.join(expected.select(key).distinct(), key, "left_anti")


def prune(present: DataFrame, expected: DataFrame, key: str = "path") -> int:
    """Removes the files that nothing expects, in batches of rows as they stream by; returns how many."""
    spark, n = present.sparkSession, 0
    for row in unexpected(present, expected, key).select(key).toLocalIterator():
        discard(spark, row[0])
        n += 1
    return n


def append_measure(rows: DataFrame, path: str, key: list[str]) -> None:
    """Appends measurements; one that is there already (by ``key``) is not written twice."""
    if exists(rows.sparkSession, path):
        rows = rows.join(rows.sparkSession.read.parquet(path).select(*key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def rewrite_paths(documents: DataFrame, ident: str, body: str, moved: DataFrame) -> DataFrame:
    """``documents`` with every quoted path that ``moved`` (old, new) names replaced, all else byte for byte.

    Texts are cut at quotes, the pieces joined with ``moved`` and put together again; a text with no quote stays whole.
    """
    pieces = documents.select(ident, F.posexplode(F.split(body, '"', -1)).alias("_p", "old"))
    changed = pieces.join(moved.groupBy("old").agg(F.min("new").alias("new")), "old", "left")
    # only what stands between two quotes is a path
    text = F.when(F.col("_p") % 2 == 1, F.coalesce("new", "old")).otherwise(F.col("old"))
    whole = changed.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("_p", text.alias("t")))).alias("_t"))
    return documents.drop(body).join(whole.select(ident, F.array_join("_t.t", '"').alias(body)), ident, "left").select(*documents.columns)

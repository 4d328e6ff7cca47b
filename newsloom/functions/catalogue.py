"""Which catalogue entry a row belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_small
from .names import fold_host, fold_name


def resolve_entry(rows: DataFrame, sources: DataFrame, source: str = "source", host: str = "sourceDomain") -> DataFrame:
    """``rows`` with ``entry`` (the catalogue name) and ``entry_*`` for the other catalogue columns.

    The source decides (name or alias, any spelling); where it names no entry, the host does (a subdomain counts as
    its host). Rows that neither tells get nulls. The catalogue is broadcast while its
    counted size allows it.
    """
    extra = [c for c in sources.columns if c not in ("source", "aliases")]
    base = sources.select(F.col("source").alias("entry"), *[F.col(c).alias(f"entry_{c}") for c in extra], F.explode(F.array_union(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_alias"))
    names = base.select(fold_name(F.col("_alias")).alias("_name"), F.struct("entry", *[f"entry_{c}" for c in extra]).alias("_by_name")).where(F.col("_name").isNotNull()).groupBy("_name").agg(F.min_by("_by_name", F.col("_by_name.entry")).alias("_by_name"))
    hosts = sources.select(fold_host(F.col("sourceDomain")).alias("_host"), F.struct(F.col("source").alias("entry"), *[F.col(c).alias(f"entry_{c}") for c in extra]).alias("_by_host")).where(F.col("_host").isNotNull()).groupBy("_host").agg(F.min_by("_by_host", F.col("_by_host.entry")).alias("_by_host"))
    out = rows.withColumns({"_name": fold_name(F.col(source)), "_host": fold_host(F.col(host))})
    out = join_small(join_small(out, names, ["_name"], row_bytes=256), hosts, ["_host"], row_bytes=256)
    pick = F.coalesce("_by_name", "_by_host")
    return out.select(*rows.columns, pick["entry"].alias("entry"), *[pick[f"entry_{c}"].alias(f"entry_{c}") for c in extra])

"""Capping rows per dominant contributor by distributed radix selection.

Every row gets a key of fixed width whose text order is its rank: the score (highest first, null last), then the
identifier (smallest first), as order-preserving bytes in hexadecimal. Per contributor the cutoff key is fixed byte by
byte from counts per contributor and byte (at most 256 counters each, summed before the shuffle); no group is sorted,
collected or held in one task, however large it is. The last step is a plain comparison of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize

#: Bytes of a rank key: 1 null flag, 8 of the score, 8 of the identifier.
KEY_BYTES = 17
_SIGN = -(1 << 63)


def rank_key(score: Column, ident: Column) -> Column:
    """34 hexadecimal digits, ascending in rank: score descending with null last, then ident ascending (null first).

    A score is taken as a long; a double keeps its order through its IEEE bits only if it is cast by the caller.
    """
    down = F.bitwise_not(score.cast("long").bitwiseXOR(F.lit(_SIGN)))
    up = F.coalesce(ident.cast("long"), F.lit(_SIGN)).bitwiseXOR(F.lit(_SIGN))
    wide = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.when(score.isNull(), F.concat(F.lit("01"), F.repeat(F.lit("0"), 16), wide(up))).otherwise(F.concat(F.lit("00"), wide(down), wide(up)))


def radix_cutoffs(keyed: DataFrame, group: list[str]) -> DataFrame:
    """One row per group that is over its limit: ``group``, ``_cut`` (a key prefix).

    ``keyed`` has the group columns, ``_key`` and ``_limit`` (the same in a whole group, null for no limit). A row is
    kept exactly if the first ``length(_cut)`` digits of its key are not greater than ``_cut``. Groups with a limit of
    0 or less get the cut ``""`` and keep nothing (see ``over_cutoff``). Bytes that are the same in all rows are
    fixed at once.
    """
    limited = keyed.where(F.col("_limit").isNotNull())
    state, done = None, []
    for _ in range(KEY_BYTES):
        if state is None:
            rows = limited.select(*group, "_key", F.col("_limit").alias("_left"), F.lit("").alias("_prefix"))
        else:
            rows = join_small(limited.drop("_limit"), state, group, "inner").where(F.expr("substring(_key, 1, length(_prefix))") == F.col("_prefix"))
        counts = rows.groupBy(*group, F.expr("substring(_key, length(_prefix) + 1, 2)").alias("_d")).agg(
            F.count("*").alias("_n"), F.max("_left").cast("long").alias("_left"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")
        )
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*group).orderBy("_d"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
        least = F.greatest("_left", F.lit(1))
        # the byte in which the limit is reached; bytes that all keys below it share are fixed with it
        at_cut = counts.where((F.col("_all") > F.col("_left")) & (F.col("_upto") >= least) & (F.col("_upto") - F.col("_n") < least))
        same = F.expr(f"array_position(transform(sequence(1, {KEY_BYTES}), i -> substring(_lo, 2 * i - 1, 2) <> substring(_hi, 2 * i - 1, 2)), true)")
        found = materialize(
            at_cut.select(
                *group,
                F.substring("_lo", F.lit(1), F.when(same == 0, 2 * KEY_BYTES).otherwise(2 * (same - 1))).alias("_prefix"),
                (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left"),
                ((F.col("_upto") == F.col("_left")) | (same == 0)).alias("_exact"),
                (F.col("_left") <= 0).alias("_none"),
            ),
            "radix",
        )
        ends = F.col("_exact") | F.col("_none")
        done.append(found.where(ends).select(*group, F.when(F.col("_none"), "").otherwise(F.col("_prefix")).alias("_cut")))
        state = found.where(~ends).select(*group, "_prefix", "_left")
        if state.isEmpty():
            break
    cuts = done[0]
    for more in done[1:]:
        cuts = cuts.unionByName(more)
    return cuts


def over_cutoff() -> Column:
    """True for a row beyond its group's cutoff; false where the group has none."""
    return F.coalesce(F.when(F.col("_cut") == "", True).otherwise(F.expr("substring(_key, 1, length(_cut))") > F.col("_cut")), F.lit(False))


def rank_rows(df: DataFrame, group: list[str], limit: str | Column, score: str, ident: str) -> DataFrame:
    """``df`` with the boolean column ``over_limit``: true beyond the best ``limit`` rows of its group.

    Rows rank by ``score`` (highest first, null last), then ``ident`` (smallest first). Null group values form a group
    of their own; a null limit caps nothing; a limit of 0 or less drops the whole group. Rows that tie in score and
    ident are decided alike, so a group may keep more than its limit then and only then. An empty ``df`` gives an
    empty result. Columns that start with an underscore are used inside and must not occur in ``df``.
    """
    clash = [c for c in df.columns if c.startswith("_") or c == "over_limit"]
    df = df.withColumnsRenamed({c: f"kept{c}" for c in clash})
    limit = F.col(limit) if isinstance(limit, str) else limit
    names = [f"_g{i}" for i in range(len(group))]
    safe = {n: F.struct(F.col(g).isNull().alias("none"), F.coalesce(F.col(g).cast("string"), F.lit("")).alias("v")).cast("string") for n, g in zip(names, group)}
    keyed = df.withColumns(safe | {"_key": rank_key(F.col(score), F.col(ident)), "_limit": limit.cast("long")})
    cuts = radix_cutoffs(keyed.select(*names, "_key", "_limit"), names)
    out = join_small(keyed, cuts, names).withColumn("over_limit", over_cutoff()).select(*df.columns, "over_limit")
    return out.withColumnsRenamed({f"kept{c}": c if c != "over_limit" else "over_limit_before" for c in clash})


def share_limits(df: DataFrame, group: list[str], share: float) -> DataFrame:
    """One row per group with ``share_limit``: the rows it may keep so that it is at most ``share`` of all rows of ``df``."""
    total = df.count()
    return df.groupBy(*group).count().select(*group, F.floor(F.lit(total * share)).cast("long").alias("share_limit"))

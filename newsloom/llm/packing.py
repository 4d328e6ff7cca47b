"""Filling containers of fixed capacity by minimum bin slack.

Per bin, a bitset subset-sum over the lengths still available (one integer of ``capacity`` bits, shifted and merged per
length) finds the fullest combination beside the largest remaining item; it is removed and the next bin begins.
Items are dealt by hash into shards of bounded size, each packed on its own; the bins a shard leaves poorly filled
are opened again and packed together in further rounds. An item is split only if it exceeds the capacity: into full
containers and one rest, which is packed as an item.

Sizes that are null or negative count as 0; items of size 0 take no room and join the first bin of their shard. Rows
that repeat an id are items of their own. A capacity that is null or below 1 holds nothing and gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Items of a shard: bounds the memory and time of a packing task.
SHARD_ITEMS = 20_000
#: A bin filled below this share is opened again in the next round.
GOOD_FILL = 0.98
ROUNDS = 2
OUT = "capacity_tokens int, bin_id string, doc_id long, piece_no int, pieces int, tokens long, bin_tokens long"


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """The lengths (with repeats, within ``counts``) whose sum is the largest not above ``room``.

    ``lengths`` are distinct and descending. The reachable sums are the bits of one integer; after each copy of a
    length the bitset is kept, so that the choice can be read back.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        if x > room:
            continue
        for _ in range(min(counts[x], room // x)):
            more = (reach | reach << x) & mask
            if more == reach:
                break
            trail.append((x, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for x, before in reversed(trail):
        if not before >> at & 1:
            out.append(x)
            at -= x
    return out


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of positions into ``sizes`` (each between 1 and ``capacity``)."""
    by: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(sizes, kind="stable"):
        by[int(sizes[i])].append(int(i))
    lengths = sorted(by, reverse=True)
    counts = {x: len(v) for x, v in by.items()}
    bins = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = [first, *fullest(capacity - first, lengths, counts)]
        counts[first] += 1
        bins.append([by[x].pop() for x in chosen])
        for x in chosen:
            counts[x] -= 1
        lengths = [x for x in lengths if counts[x]]
    return bins


def _pack_group(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    capacity, shard, turn = int(key[0]), key[1], key[2]
    df = df.reset_index(drop=True)
    size = df["tokens"].to_numpy(dtype=np.int64)
    real = np.flatnonzero(size > 0)
    bins = [[int(real[i]) for i in b] for b in pack_sizes(size[real], capacity)]
    empty = [int(i) for i in np.flatnonzero(size == 0)]
    if empty:
        bins = bins or [[]]
        bins[0] = bins[0] + empty
    number = np.zeros(len(df), dtype=np.int64)
    filled = np.zeros(len(df), dtype=np.int64)
    for n, b in enumerate(bins):
        number[b] = n
        filled[b] = size[b].sum()
    return pd.DataFrame({"capacity_tokens": capacity, "bin_id": [f"{turn}-{shard}-{n}" for n in number], "doc_id": df["doc_id"], "piece_no": df["piece_no"], "pieces": df["pieces"], "tokens": size, "bin_tokens": filled})


def pack(items: DataFrame, capacities: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers for ``items`` (doc_id, tokens), for each ``capacity_tokens`` of ``capacities``.

    One row per piece: capacity_tokens, bin_id, doc_id, piece_no (from 0), pieces, tokens, bin_tokens. The capacities
    are a few rows and travel in the plan. No items, or no capacities, give no rows.
    """
    caps = sorted({int(r[0]) for r in capacities.select("capacity_tokens").distinct().collect() if r[0] is not None and r[0] > 0})
    sized = items.select("doc_id", F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    each = sized.withColumn("capacity_tokens", F.explode(F.array(*[F.lit(c) for c in caps]).cast("array<int>")))
    pieces = F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("int"), F.lit(1))
    each = each.withColumn("pieces", pieces)
    # full containers of an oversized item need no packing
    whole = each.where("pieces > 1").withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("pieces") - 2)))
    cap = F.col("capacity_tokens").cast("long")
    whole = whole.select("capacity_tokens", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("bin_id"), "doc_id", "piece_no", "pieces", cap.alias("tokens"), cap.alias("bin_tokens"))
    rest = each.select("capacity_tokens", "doc_id", (F.col("pieces") - 1).alias("piece_no"), "pieces", (F.col("tokens") - (F.col("pieces") - 1) * F.col("capacity_tokens")).alias("tokens"))
    n = max(1, -(-sized.count() // shard_items))
    todo = rest.withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(n)).cast("int"))
    done = whole
    for turn in range(ROUNDS):
        packed = materialize(todo.withColumn("_turn", F.lit(turn)).groupBy("capacity_tokens", "_shard", "_turn").applyInPandas(_pack_group, OUT), "packed")
        good = F.col("bin_tokens") >= GOOD_FILL * F.col("capacity_tokens")
        if turn == ROUNDS - 1:
            return done.unionByName(packed)
        done = done.unionByName(packed.where(good))
        left = packed.where(~good)
        n = max(1, -(-left.count() // (len(caps) * shard_items or 1)))
        todo = left.select("capacity_tokens", "doc_id", "piece_no", "pieces", "tokens", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(n)).cast("int").alias("_shard"))
    return done

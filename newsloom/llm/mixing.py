"""Mixing sources to target weights by pivotal (dependent) rounding.

Of a source with ``size`` tokens, ``weight * total`` tokens are wanted, so each of its documents gets the same expected
number of copies: a whole part, and a fraction that is rounded dependently. Two documents with open fractions meet;
token mass moves at random from one to the other until one fraction is 0 or 1, with odds that keep both expectations.
Pairing starts within partitions; the one open document that each partition keeps per source, and its ``RESERVE``
smallest, climb a reduction tree. At the root the open document is rounded, and what that misses is handed to the
reserve, from its largest document to its smallest, so a source misses its tokens by about its smallest document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Open documents that one task of the reduction tree combines, per source.
FAN_IN = 64
#: Smallest documents of a source that stay open until the root, to take up what rounding the last one misses.
RESERVE = 128
_OPEN = "source string, doc_id long, tokens long, whole int, p double, open boolean, part int"


_FIELDS = ["source", "doc_id", "tokens", "whole", "p"]
#: Documents of one group of the first step.
GROUP = 50_000


def _uniform(*of: object) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, of))) / 2**64


def settle(i: dict, j: dict, u: float) -> tuple[dict, dict | None]:
    """One meeting: returns a settled document and the one still open (None if both are settled).

    ``size_i * p_i + size_j * p_j`` stays, and so do both expectations. A document without tokens has no mass to move;
    it is settled alone.
    """
    for x, y in ((i, j), (j, i)):
        if x["tokens"] <= 0:
            x["p"] = 1.0 if u < x["p"] else 0.0
            return x, y
    up = min((1 - i["p"]) * i["tokens"], j["p"] * j["tokens"])  # mass to i
    down = min(i["p"] * i["tokens"], (1 - j["p"]) * j["tokens"])  # mass to j
    moved = up if u < down / (up + down) else -down
    i["p"] += moved / i["tokens"]
    j["p"] -= moved / j["tokens"]
    for x in (i, j):
        x["p"] = 0.0 if x["p"] < 1e-9 else 1.0 if x["p"] > 1 - 1e-9 else x["p"]
    if i["p"] in (0.0, 1.0):
        return i, None if j["p"] in (0.0, 1.0) else j
    return j, i


def _reduce(rows: Iterator[dict], seed: int, part: int) -> Iterator[dict]:
    """Settles all but one open document and the reserve, per source."""
    held: dict[str, dict] = {}
    small: dict[str, list] = {}
    for x in rows:
        x["part"] = part
        if not 0 < x["p"] < 1:
            yield x | {"open": False}
            continue
        heap = small.setdefault(x["source"], [])
        entry = (-x["tokens"], -x["doc_id"], id(x), x)
        if len(heap) < RESERVE:
            heapq.heappush(heap, entry)
            continue
        x = heapq.heappushpop(heap, entry)[3]
        other = held.pop(x["source"], None)
        if other is None:
            held[x["source"]] = x
            continue
        done, left = settle(other, x, _uniform(seed, other["doc_id"], x["doc_id"]))
        yield done | {"open": False}
        if left is None:
            yield (x if done is other else other) | {"open": False}
        elif 0 < left["p"] < 1:
            held[x["source"]] = left
        else:
            yield left | {"open": False}
    for x in [*held.values(), *(e[3] for heap in small.values() for e in heap)]:
        yield x | {"open": True}


def finish(df: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The root, for one source: rounds from the largest open document to the smallest, handing on what each misses."""
    df = df.sort_values(["tokens", "doc_id"], ascending=[False, True]).reset_index(drop=True)
    p, size = df["p"].to_numpy(dtype=float).copy(), df["tokens"].to_numpy(dtype=float)
    for i in range(len(p)):
        r = float(_uniform(seed, "root", df["doc_id"][i]) < p[i])
        missed, p[i] = size[i] * (p[i] - r), r
        rest = slice(i + 1, None)
        for _ in range(4):
            room = np.where(size[rest] > 0, (1 - p[rest]) if missed > 0 else p[rest], 0.0)
            able = size[rest][room > 1e-12].sum()
            if abs(missed) < 1e-9 or able <= 0:
                break
            step = np.where(room > 1e-12, np.clip(missed / able, -room, room), 0.0)
            p[rest] += step
            missed -= float((step * size[rest]).sum())
    df["p"] = p
    return df


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """Copies of each document: source, doc_id, tokens, copies (0 to max_repeats), one row per row of ``docs`` with a target.

    ``docs``: doc_id, source, tokens; ``targets``: source, target_weight, max_repeats (a few rows). ``total`` is the
    wanted size in tokens; None means the largest at which every source that is present reaches its share. Where
    ``total`` is more than a source can give, that source gives ``max_repeats`` of everything and falls short, which
    the shares show. Weights are taken over the sources present. Null, negative and zero sizes count as 0 tokens (no
    share, copied like the rest of the source); null sources and weights of 0 or null take no part. Empty tables
    give no rows.
    """
    docs = docs.where(F.col("source").isNotNull()).select("source", F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    goal = {r["source"]: (float(r["target_weight"]), int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in targets.select("source", "target_weight", "max_repeats").collect() if r["source"] is not None and r["target_weight"] and r["target_weight"] > 0}
    have = {r["source"]: int(r["n"]) for r in docs.where(F.col("source").isin(list(goal))).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    present = {s for s, n in have.items() if n and goal[s][1] > 0}
    scale = sum(goal[s][0] for s in present) or 1.0
    most = min((goal[s][1] * have[s] * scale / goal[s][0] for s in present), default=0.0)
    size = most if total is None else float(total)
    want = {s: min(float(goal[s][1]), goal[s][0] / scale * size / have[s]) for s in present}
    rate = F.create_map(*[F.lit(x) for s, c in want.items() for x in (s, c)])[F.col("source")] if want else F.lit(0.0)
    rows = docs.where(F.col("source").isin(sorted(want))).withColumn("_c", rate)
    whole = F.floor(F.col("_c") + 1e-9).cast("int")
    rows = rows.select("source", "doc_id", "tokens", whole.alias("whole"), F.greatest(F.col("_c") - whole, F.lit(0.0)).alias("p"))
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))

    # groups of bounded size by a hash of the document, in order: the result doesn't depend on files or arrival
    parts = max(1, -(-rows.count() // GROUP))

    def first(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["source", "doc_id", "tokens"])
        records = (dict(zip(_FIELDS, r)) for r in zip(*(df[c].tolist() for c in _FIELDS)))
        return pd.DataFrame(list(_reduce(records, seed, int(key[0]))))[[*_FIELDS, "open", "part"]]

    state = materialize(rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("_part")).applyInPandas(first, _OPEN), "pivot")
    done, left = [state.where("not open")], state.where("open")
    while parts > 1:
        parts = -(-parts // FAN_IN)

        def join(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            df = df.sort_values(["doc_id", "tokens"])
            records = (dict(zip(_FIELDS, r)) for r in zip(*(df[c].tolist() for c in _FIELDS)))
            return pd.DataFrame(list(_reduce(records, seed, int(key[1]))))[[*_FIELDS, "open", "part"]]

        state = materialize(left.groupBy("source", F.floor(F.col("part") / FAN_IN).cast("int").alias("_to")).applyInPandas(join, _OPEN), "pivot")
        done.append(state.where("not open"))
        left = state.where("open")
    out = left.groupBy("source").applyInPandas(lambda df: finish(df, seed), _OPEN)
    for more in done:
        out = out.unionByName(more)
    return out.select("source", "doc_id", "tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: what was wanted and what was reached; a source that is absent reaches 0."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.count("*").alias("n_docs"))
    total = got.agg(F.sum("mixed_tokens").alias("_all"))
    out = targets.join(got, "source", "left").join(F.broadcast(total), F.lit(True), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_weight", "max_repeats", zero("n_docs"), zero("copies"), zero("most_copies"), zero("mixed_tokens"), (F.coalesce("mixed_tokens", F.lit(0)) / F.col("_all")).alias("actual_share"))

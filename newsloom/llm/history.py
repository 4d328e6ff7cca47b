"""Deduplicating new batches against all history with persisted inverted-file vector cells.

A headline is a sparse vector: its character n-grams, hashed into dimensions and weighted by inverse document frequency
(fitted once, on the first block, then frozen, so that vectors stay comparable). The cells are the dimensions. A vector
is filed in the cells of its heaviest dimensions, as many as hold more than ``RADIUS`` of its squared length (numbers
count as a dimension that outweighs all others): the heaviest dimension that two vectors within the radius share is
among these cells of both, so a probe of a new vector's own cells finds every vector within the radius, and no further
cell can hold a nearer match. Every vector has a signature, whose differing bits bound the distance from below; pairs
beyond the bound are not reranked, all others are compared exactly by their full vectors. A posting carries the signature,
so a pair is judged where its cell is and only pairs within the bound are moved; large blocks meet in their cells slot by
slot. New vectors are appended to the cells.

The index lives in a folder: ``weights``, ``vectors`` (full vectors, texts), ``cells``, ``cut_cells``, ``taken``
(accepted rows by page and by headline) and ``links``, each partitioned by block and, where it is probed, by slot of its key. A block only reads the slots it asks for and keeps what matches its keys before anything is shuffled. A block
counts from the moment it is listed in ``commits``; what a broken run left is not read.

Exact copies (same page, same folded headline) are contracted before any vector is made, so hot groups of copies cost
one vector each. A cell that holds more than ``HOT`` headlines of the same numbers is split by the next dimension that two
vectors within the radius must share.
"""

from __future__ import annotations

import gc
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.urls import page_key
from ..session import BROADCAST_BYTES, Scratch, discard, materialize, shared_dir
from . import headlines as H

#: Texts that the weights assume at least: in a small first block a slip must not outweigh a headline.
LEAST_TEXTS = 10_000
#: Slots of the index's folders by cell or key.
SLOTS = 4
#: Headlines of a cell from which it is split by a second dimension, and the share of postings on which cells are counted for
#: that: whether a cell is split changes the work, not the result.
HOT, COUNTED = 256, 1 / 16
#: Bytes of compared texts that meet in one step, and of postings from which the cells are worked through slot by slot, that being
#: a slot's share of them: what a join moves lies on disk until it ends. At most ``STEPS`` steps of texts, as each moves the other
#: side's again.
SLICE_BYTES, STEPS = 4 * BROADCAST_BYTES, 8
#: Undecided edges from which on the greedy choice is finished by one task instead of another round.
FEW = 500_000
_SIG = [f"s{i}" for i in range(H.SIGNATURE)]
_POSTING = "key long, id long, n int, " + ", ".join(f"{s} long" for s in _SIG)
_COLUMNS = [c.split()[0] for c in _POSTING.split(", ")]
_IDS = [f"{k}.id {p}" for k, p in (("x", "p"), ("y", "q"))]
_VECTOR = "t binary, id long, cut boolean, raw string, dims binary, num int"
_TAKEN = "hub binary, row long"
_SLOTTED = ("cells", "taken")
#: While a block is taken in: shuffle files of a step go when it ends, rather than when the driver collects its garbage, and a
#: task writes all slots side by side instead of sorting its rows by slot.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": str(SLOTS)}


def _keys(batches: Iterator[pd.DataFrame], names: frozenset[str]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_128_digest
    for df in batches:
        plain = [H.plain_title(t) for t in df["title"]]
        raw = [H.strip_site(t, names) for t, _ in plain]
        cut = [c for _, c in plain]
        folded = [H.fold(r) for r in raw]
        pages = [page_key(u) or (None if f else f"#{r}") for u, f, r in zip(df["url"], folded, df["row_id"])]
        u = [digest(f"u{p}") if p else None for p in pages]
        t = [digest(f"t{f}…" if c else f"t{f}") if f else None for f, c in zip(folded, cut)]
        k = [digest((x or b"") + b"|" + (y or b"")) for x, y in zip(u, t)]
        yield pd.DataFrame({"row_id": df["row_id"].to_numpy(), "k": pd.Series(k, dtype=object), "u": pd.Series(u, dtype=object), "t": pd.Series(t, dtype=object), "raw": pd.Series(raw, dtype=object), "cut": np.array(cut, dtype=bool)})


def _packed(starts: np.ndarray, dims: np.ndarray) -> list[bytes]:
    """Sorted dimensions as 16-bit gaps; a gap of 65535 only moves on."""
    gap = np.diff(dims, prepend=0)
    heads = starts[:-1][np.diff(starts) > 0]
    gap[heads] = dims[heads]
    more = gap // 65535
    flat = np.full(len(gap) + int(more.sum()), 65535, dtype=np.uint16)
    ends = np.cumsum(more + 1)
    flat[ends - 1] = gap % 65535
    at = np.concatenate([[0], ends])[starts]
    return [flat[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]


def _vector(packed: bytes) -> np.ndarray:
    gap = np.frombuffer(packed, dtype=np.uint16)
    return np.cumsum(gap, dtype=np.int64)[gap != 65535]


def _unpacked(dims: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Start of each vector, and all dimensions, of many packed vectors."""
    gap = np.frombuffer(b"".join(dims), dtype=np.uint16)
    size = np.fromiter((len(x) // 2 for x in dims), dtype=np.int64, count=len(dims))
    at = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([[0], np.cumsum(gap, dtype=np.int64)])
    real = gap != 65535
    starts = np.concatenate([[0], np.cumsum(real)])[at]
    return starts, (total[1:] - np.repeat(total[at[:-1]], size))[real]


def _may_tell(p: pd.Series, q: pd.Series, cut: np.ndarray) -> np.ndarray:
    """Which pairs of packed vectors share enough dimensions to tell one story, as ``same_story`` asks it; all that are cut."""
    (starts_p, dims_p), (starts_q, dims_q) = _unpacked(p), _unpacked(q)
    n_p, n_q = np.diff(starts_p), np.diff(starts_q)
    at = np.arange(len(p)) << H.DIM_BITS
    both = np.sort(np.concatenate([np.repeat(at, n_p) | dims_p, np.repeat(at, n_q) | dims_q]))
    shared = np.bincount(both[1:][both[1:] == both[:-1]] >> H.DIM_BITS, minlength=len(p))
    return cut | (2 * shared >= H.SIMILAR * (n_p + n_q))


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        folded = [H.fold(r) for r in df["raw"]]
        starts, dims = H.vectors(folded)
        df["id"] = [int.from_bytes(t[:8], "little", signed=True) for t in df["t"]]
        df["dims"] = _packed(starts, dims)
        df["num"] = [H.number_key(f) for f in folded]
        yield df


def _posted(key: np.ndarray, who: np.ndarray, ids: np.ndarray, starts: np.ndarray, dims: np.ndarray) -> pd.DataFrame:
    """Postings of the headlines ``who``, each with the size and the signature of its headline."""
    signs = H.signatures(starts, dims)[who]
    return pd.DataFrame({"key": key, "id": ids[who], "n": np.diff(starts).astype(np.int32)[who]} | {s: signs[:, i] for i, s in enumerate(_SIG)})


def _bits(*of: Column) -> Column:
    out = F.bit_count(of[0])
    for x in of[1:]:
        out = out + F.bit_count(x)
    return out


def _within(part: bool) -> Column:
    """Whether the signatures of postings x and y leave it open that they tell one story: differing bits bound the distance
    from below. part: x is cut, and only what x has and y lacks counts."""
    if part:
        return _bits(*[F.col(f"x.{s}").bitwiseAND(F.bitwise_not(f"y.{s}")) for s in _SIG]) <= (1 - H.BEGINS) * F.col("x.n")
    return _bits(*[F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}")) for s in _SIG]) <= (1 - H.SIMILAR) * (F.col("x.n") + F.col("y.n"))


class HistoryIndex:
    """All that was seen so far, below ``path`` (given, or in the shared folder): opens what is there, else starts anew.

    Rows without a usable title are told by their page only, rows without a usable address by their title only; a row
    with neither is always accepted. Ties of row_id are one row. An empty block changes nothing.
    """

    def __init__(self, spark: SparkSession, site_names: frozenset[str] = frozenset(), path: str | None = None) -> None:
        self.spark, self.names = spark, frozenset(n.casefold() for n in site_names)
        self.path = path or f"{shared_dir(spark)}/newsloom/history-{uuid.uuid4().hex}"
        self.blocks = self._committed()
        self.weight = None
        if self.blocks:
            got = spark.read.parquet(f"{self.path}/weights").toArrow().to_pandas()
            self.weight = np.full(H.CLASSES, got["other"].iloc[0], dtype=np.float32)
            self.weight[got["b"].to_numpy(dtype=np.int64)] = got["w"].to_numpy(dtype=np.float32)

    def _exists(self, name: str) -> bool:
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there)

    def _committed(self) -> list[int]:
        return sorted(r[0] for r in self.spark.read.schema("block int").parquet(f"{self.path}/commits").collect()) if self._exists("commits") else []

    def _read(self, name: str, schema: str, slots: list[int] | None = None, block: int | None = None) -> DataFrame | None:
        """A table of the index, its committed blocks (or the one being written) and the wanted slots only; None if nothing is there."""
        blocks = self.blocks if block is None else [block]
        if not blocks:
            return None
        full = StructType.fromDDL(schema + ", block int" + (", slot int" if name in _SLOTTED else ""))
        out = self.spark.read.schema(full).parquet(f"{self.path}/{name}").where(F.col("block").isin(blocks))
        return out if slots is None else out.where(F.col("slot").isin(slots))

    def _append(self, df: DataFrame, name: str, key: str = "") -> DataFrame:
        """Writes a block's share of an index table, and reads it back."""
        schema = df.schema
        df, by = df.withColumn("block", F.lit(len(self.blocks))), ["block"]
        if name in _SLOTTED:
            df, by = df.withColumn("slot", self._slot(key)), ["block", "slot"]
        df.write.mode("append").option("compression", "zstd" if name == "cells" else "snappy").partitionBy(*by).parquet(f"{self.path}/{name}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return self._read(name, ddl, block=len(self.blocks)).select(*schema.names)

    def _slot(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")

    def _near_keys(self, name: str, schema: str, key: str, asked: DataFrame, most: int) -> DataFrame | None:
        """The rows of an index table whose ``key`` is among ``asked`` (one column, ``most`` rows at most): only the slots asked
        for are read, and what doesn't match goes before any shuffle while the keys are few enough to be carried."""
        if not self.blocks:
            return None
        # many keys ask for every slot
        slots = sorted(r[0] for r in asked.select(self._slot(key)).distinct().collect()) if most <= 4 * SLOTS else None
        return self._read(name, schema, slots).select(*[c.split()[0] for c in schema.split(", ")]).join(carried(asked, most, 40), key, "left_semi")

    def _fit(self, texts: DataFrame) -> None:
        """Document frequencies of all classes over the first block; ``CLASSES`` counters at most reach the driver."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, total = np.zeros(H.CLASSES, dtype=np.int64), 0
            words: Counter = Counter()
            for df in batches:
                total += len(df)
                n += np.bincount(_unpacked(df["dims"])[1] & (H.CLASSES - 1), minlength=H.CLASSES)
                for r in df["raw"]:
                    words.update(set(H.fold(r).split()))
            for w, k in words.items():
                n[H.word_class(w)] += k
            at = np.flatnonzero(n)
            yield pd.DataFrame({"b": np.append(at, -1), "n": np.append(n[at], total)})

        got = texts.select("dims", "raw").mapInPandas(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        total = max(LEAST_TEXTS, int(got.loc[got["b"] < 0, "n"].sum()))
        got = got[got["b"] >= 0]
        other = float(np.log((total + 1) / 0.5))
        self.weight = np.full(H.CLASSES, other, dtype=np.float32)
        self.weight[got["b"].to_numpy(dtype=np.int64)] = np.log((total + 1) / (got["n"].to_numpy() + 0.5)).clip(0.05)
        got = got.assign(w=self.weight[got["b"].to_numpy(dtype=np.int64)].astype(float), other=other)
        got = got[["b", "w", "other"]] if len(got) else pd.DataFrame({"b": [0], "w": [other], "other": [other]})
        rows = self.spark.createDataFrame(pa.Table.from_pandas(got, preserve_index=False))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/weights")

    def _postings(self, texts: DataFrame) -> DataFrame:
        weight_b = self.spark.sparkContext.broadcast(H.Weights(self.weight))

        def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                starts, dims = _unpacked(df["dims"])
                who, cell = H.cells_of(starts, dims, weight_b.value)
                yield _posted(cell << 31 | df["num"].to_numpy(dtype=np.int64)[who], who, df["id"].to_numpy(), starts, dims)

        return texts.select("dims", "num", "id").mapInPandas(file, _POSTING)

    def _hot(self, postings: DataFrame, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, DataFrame] | None:
        """The keys of hot cells, their number, and the postings of these cells filed under two dimensions: the cell, and each
        lighter one that may be the next that a vector within the radius shares. The key of two dimensions is a hash below 0."""
        share = min(1.0, max(COUNTED, 4 / HOT))
        hot = scratch.write(postings.where(F.rand(11) < share).groupBy("key").count().where(F.col("count") > HOT * share).select("key"))
        hot_keys = np.sort(hot.toPandas()["key"].to_numpy(dtype=np.int64))
        n = len(hot_keys)
        if not n:
            return None
        shared_b = self.spark.sparkContext.broadcast((H.Weights(self.weight), hot_keys))

        def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weights, hot_ = shared_b.value
            for df in batches:
                starts, dims = _unpacked(df["dims"])
                who, cell = H.cells_of(starts, dims, weights)
                key = cell << 31 | df["num"].to_numpy(dtype=np.int64)[who]
                is_hot = hot_[np.minimum(np.searchsorted(hot_, key), n - 1)] == key
                _, d_all, w_all = weights.ordered(starts, dims)
                rows, keys = [], []
                for i, c in zip(who[is_hot].tolist(), key[is_hot].tolist()):
                    d, w = d_all[starts[i] : starts[i + 1]], w_all[starts[i] : starts[i + 1]]
                    lost, all_ = np.cumsum(w) - w, w.sum()
                    at = int(np.flatnonzero(d == c >> 31)[0])
                    # from the cell on, what lies between it and the next shared dimension is lost as well
                    ok = np.flatnonzero(lost[at + 1 :] - w[at] <= H.RADIUS * all_) + at + 1
                    two = [int(x) for x in d[ok]]
                    if all_ - w[at] <= H.RADIUS * all_:  # the cell alone may be all that is shared
                        two.append(-1)
                    rows += [i] * len(two)
                    keys += [-1 - (xxhash.xxh64_intdigest(f"{c},{x}") >> 1) for x in two]
                yield _posted(np.array(keys, dtype=np.int64), np.array(rows, dtype=np.int64), df["id"].to_numpy(), starts, dims)

        return hot, n, texts.select("dims", "num", "id").mapInPandas(second, _POSTING)

    def ingest(self, block: DataFrame) -> DataFrame:
        """Check a block (row_id, title, url) against history and itself, append what is accepted, return ``row_id_a``, ``row_id_b``."""
        before = {k: self.spark.conf.get(k) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            with Scratch(self.spark, "ingest") as scratch:
                out = self._ingest(block, scratch)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        self.spark.createDataFrame([(len(self.blocks),)], "block int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.blocks = self._committed()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # shuffles of the block are cleaned once nothing refers to them
        return out

    def _ingest(self, block: DataFrame, scratch: Scratch) -> DataFrame:
        names = self.names
        with Scratch(self.spark, "keyed") as early:
            keyed = early.write(block.select("row_id", "title", "url").mapInPandas(lambda it: _keys(it, names), "row_id long, k binary, u binary, t binary, raw string, cut boolean"))
            size = keyed.count()
            # contract copies: one node per page and headline, its first row stands for it; a headline's first row gives its text
            # (at most half as many keys as rows come more than once)
            several = lambda key: carried(keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("row_id").alias("row"), F.count("*").alias("c")).where("c > 1").drop("c"), size // 2, 60)
            rows = scratch.write(keyed.select("row_id", "k", "u", "t").join(several("k"), "k", "left").select("row_id", F.coalesce("row", "row_id").alias("row"), "u", "t"))
            nodes = rows.where("row_id = row").select("row", "u", "t")
            texts = keyed.where("t is not null").join(several("t"), "t", "left").where("row is null or row = row_id").select("t", "raw", "cut")
            if self.blocks:
                seen = self._read("vectors", _VECTOR).select("t").join(carried(texts.select("t"), size, 40), "t", "left_semi")
                texts = texts.join(carried(seen, size, 40), "t", "left_anti")
            fresh = self._append(texts.mapInPandas(_vectors, _VECTOR), "vectors")
        if self.weight is None:
            self._fit(fresh)
        links = self._links(fresh, size, scratch)
        decided = self._resolve(nodes, links, size, scratch)
        # append: accepted rows by page and by headline; new texts with their vectors, cells and links are there already. What
        # was there is not written again. A text of which no row was accepted stays in the cells, but without an accepted row
        # it tells nothing
        rejected = decided.where("a <> row")
        accepted = nodes.join(carried(rejected.select("row"), size, 40), "row", "left_anti")
        self._append(accepted.select(F.explode(F.array_compact(F.array("u", "t"))).alias("hub"), "row"), "taken", "hub")
        out = rows.select("row_id", "row").join(carried(rejected, size, 60), "row", "left").select(F.coalesce("a", "row").alias("row_id_a"), F.col("row_id").alias("row_id_b"))
        return materialize(out.where("row_id_a < row_id_b").distinct(), "repeats")

    def _links(self, fresh: DataFrame, size: int, scratch: Scratch) -> DataFrame:
        """Fresh headlines and those, fresh or in history, that tell the same story: (t, o) both ways round.

        Headlines that were cut lie in cells of their own (``cut_cells``), as they may lack numbers: they are few, and are
        carried to the cells of the whole ones while their size allows it.
        """
        whole = fresh.where("not cut")
        n_new = self._append(self._postings(whole), "cells", "key").count()
        n_cut = self._append(self._postings(fresh.where("cut")), "cut_cells").count()
        n_old = self._read("cells", _POSTING).count() if self.blocks and n_new > 4 * SLOTS else 0
        texts = fresh
        if self.blocks:
            texts = texts.unionByName(self._read("vectors", _VECTOR).select(*fresh.columns))
        n_old_cut = self._read("cut_cells", _POSTING).count() if self.blocks else 0
        with Scratch(self.spark, "pairs") as early:
            hot = self._hot(self._read("cells", _POSTING, block=len(self.blocks)), whole, early)
            if (n_new + n_old) * 50 <= SLICE_BYTES // SLOTS:
                pairs = scratch.write(_told_once(self._pairs(None, hot, n_new) + self._cut_pairs(None, n_cut, n_old_cut)))
            else:  # what meets at once is a slot's share; cut headlines that are carried meet all slots, as nothing else is moved
                if hot:
                    hot = (*hot[:2], early.write(hot[2]))
                each = [[s] for s in range(SLOTS)]
                steps = [self._pairs(s, hot, n_new) for s in each]
                steps += [self._cut_pairs(s, n_cut, n_old_cut) for s in ([None] if max(n_cut, n_old_cut) * 64 <= BROADCAST_BYTES else each)]
                pairs = scratch.write(_union([early.write(_told_once(s)) for s in steps]).distinct())
        # only the vectors that are compared are moved
        with Scratch(self.spark, "wanted") as early:
            wanted = early.write(pairs.select(F.explode(F.array("p", "q")).alias("id")).distinct())
            n, n_pairs = wanted.count(), pairs.count()
            texts = scratch.write(_union([texts.join(w, "id", "left_semi") for w in _carried_parts(wanted, "id", n, 24)]))
        weight_b = self.spark.sparkContext.broadcast(self.weight)

        def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                df = df[_may_tell(df["dims_p"], df["dims_q"], (df["cut_p"] | df["cut_q"]).to_numpy(dtype=bool))]
                ok = [
                    H.same_story(H.fold(ra), H.fold(rb), _vector(ga), _vector(gb), ra, rb, ca, cb, weight_b.value)
                    for ga, gb, ra, rb, ca, cb in zip(df["dims_p"], df["dims_q"], df["raw_p"], df["raw_q"], df["cut_p"], df["cut_q"])
                ]
                got = df.loc[ok, ["t_p", "t_q"]]
                yield pd.DataFrame({"t": pd.concat([got["t_p"], got["t_q"]]), "o": pd.concat([got["t_q"], got["t_p"]])})

        steps = min(STEPS, max(1, -(-n_pairs * 600 // SLICE_BYTES)))
        for i in range(steps):
            mine = lambda df, k: df if steps == 1 else df.where(F.pmod(k, F.lit(steps)) == i)  # noqa: E731, B023
            side = lambda df, k: carried(df.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("t", "raw", "cut", "dims")]), n, 500)
            met = mine(pairs, "p").repartition(16).join(side(mine(texts, "id"), "p"), "p").join(side(texts, "q"), "q").drop("p", "q")
            links = self._append(met.mapInPandas(rerank, "t binary, o binary"), "links")
        return links

    def _pairs(self, slots: list[int] | None, hot: tuple[DataFrame, int, DataFrame] | None, n_new: int) -> list[DataFrame]:
        """Pairs (p, q) of this block's whole headlines with each other and with history's that meet in a cell of ``slots`` (all, if
        None) and whose signatures don't tell them apart. hot: what ``_hot`` gave for the block."""
        new = plain = self._read("cells", _POSTING, slots, len(self.blocks)).select(*_COLUMNS)
        if hot:
            keys, n_hot, more = hot
            plain = new.join(carried(keys, n_hot, 40), "key", "left_anti").unionByName(more if slots is None else more.where(self._slot("key").isin(slots)))
        small = n_new * 64 <= BROADCAST_BYTES
        build = lambda df: F.broadcast(df) if small else df.hint("shuffle_hash")
        same = F.col("x.key") == F.col("y.key")
        found = [plain.alias("x").join(build(plain).alias("y"), same & (F.col("x.id") < F.col("y.id")) & _within(False)).selectExpr(*_IDS)]
        if self.blocks:
            # a small block is carried to the cells it asks for, a large one meets them in a shuffle
            near = self._near_keys("cells", _POSTING, "key", new.select("key"), n_new) if n_new <= 4 * SLOTS else self._read("cells", _POSTING, slots).select(*_COLUMNS)
            found.append(near.alias("y").join(build(new).alias("x"), same & _within(False)).selectExpr(*_IDS))
        return found

    def _cut_pairs(self, slots: list[int] | None, n_cut: int, n_old_cut: int) -> list[DataFrame]:
        """As ``_pairs``, of headlines of which one at least was cut."""
        new = self._read("cells", _POSTING, slots, len(self.blocks)).select(*_COLUMNS)
        new_cut = self._read("cut_cells", _POSTING, block=len(self.blocks)).select(*_COLUMNS)
        # cut headlines lie in no slot: the first one takes those that are looked up, all slots those that look
        with_cut = lambda df, cut: df.unionByName(cut) if slots is None or slots[0] == 0 else df
        # the numbers of a cut headline may be cut off: its cells are looked up alone
        by_cell = (F.shiftright("x.key", 31) == F.shiftright("y.key", 31)) & (F.col("x.id") != F.col("y.id")) & _within(True)
        cut_x = carried(new_cut, n_cut, 64).alias("x")
        found = [cut_x.join(with_cut(new, new_cut).alias("y"), by_cell).selectExpr(*_IDS)]
        if self.blocks:
            old, old_cut = self._read("cells", _POSTING, slots).select(*_COLUMNS), self._read("cut_cells", _POSTING).select(*_COLUMNS)
            found.append(cut_x.join(with_cut(old, old_cut).alias("y"), by_cell).selectExpr(*_IDS))
            found.append(carried(old_cut, n_old_cut, 64).alias("x").join(with_cut(new, new_cut).alias("y"), by_cell).selectExpr(*_IDS))
        return found

    def _resolve(self, nodes: DataFrame, links: DataFrame, size: int, scratch: Scratch) -> DataFrame:
        """(row, a) of all nodes that have anything in common with another: the accepted row they repeat, themselves if accepted.
        Greedy in row order, in parallel rounds; a node that is not listed is accepted.

        Page and headline are hubs that a node provides and asks, so copies never meet in pairs; a node also asks the
        headlines its own is linked with. In a round a node is rejected if an accepted one provides a hub it asks, and
        accepted if no undecided node before it does. What is left of a few edges is decided in order by one task.
        """
        near, n_near = links, links.count()
        if self.blocks:  # a text of the block that isn't fresh has its links in history
            mine = carried(nodes.where("t is not null").select("t").distinct(), size, 40)
            past = self._read("links", "t binary, o binary").select("t", "o")
            near, n_near = near.unionByName(past.join(mine, "t", "left_semi")), n_near + past.count()
        own = nodes.select("row", F.explode(F.array_compact(F.array("u", "t"))).alias("hub")).withColumn("own", F.lit(True))
        asks = nodes.where("t is not null").select("row", "t").join(carried(near, n_near, 60), "t").select("row", F.col("o").alias("hub"), F.lit(False).alias("own"))
        edges = own.unionByName(asks)
        # only hubs that more than one node has to do with, or history has, decide anything
        hot = edges.groupBy("hub").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("hub")
        before = None
        if self.blocks:
            held = self._near_keys("taken", _TAKEN, "hub", edges.select("hub"), 2 * size + n_near)
            before = scratch.write(held.groupBy("hub").agg(F.min("row").alias("ma")))
            hot = hot.unionByName(before.select("hub"))
        edges = scratch.write(edges.join(carried(hot, size + n_near, 40), "hub", "left_semi"))
        done, acc = [], None  # acc: hubs with the smallest row accepted in the round before
        none = F.lit(None).cast("long")
        while True:
            hubs = edges.where("own").groupBy("hub").agg(F.min("row").alias("mt")).withColumn("ma", none)
            for known in (before, acc):
                if known is not None:
                    hubs = hubs.unionByName(known.select("hub", none.alias("mt"), "ma"))
            if edges.count() <= FEW:
                done.append(scratch.write(edges.join(hubs.where("ma is not null").groupBy("hub").agg(F.min("ma").alias("ma")), "hub", "left").coalesce(1).mapInPandas(_in_order, "row long, a long")))
                break
            hubs = hubs.groupBy("hub").agg(F.min("mt").alias("mt"), F.min("ma").alias("ma"))
            told = edges.join(hubs, "hub", "left").groupBy("row").agg(F.min("ma").alias("ma"), F.min("mt").alias("mt"))
            told = scratch.write(told.select("row", F.when(F.col("ma").isNotNull(), F.col("ma")).when(F.coalesce("mt", "row") >= F.col("row"), F.col("row")).alias("a")))
            done.append(told.where("a is not null"))
            todo = scratch.write(edges.join(told.where("a is null").select("row"), "row"))
            won = told.where("a = row").select("row")
            acc = scratch.write(edges.where("own").join(won, "row").join(todo.select("hub").distinct(), "hub", "left_semi").groupBy("hub").agg(F.min("row").alias("ma")))
            edges, before = todo, None
        return _union(done)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decides nodes in row order; at most ``FEW`` edges (hub, row, own, ma: the smallest row accepted before) come here."""
    edges = pd.concat(list(batches) or [pd.DataFrame({"hub": [], "row": [], "own": [], "ma": []})])
    taken = {h: int(m) for h, m in zip(edges["hub"], edges["ma"]) if m == m and m is not None}
    asks: dict[int, list] = {}
    gives: dict[int, list] = {}
    for hub, row, own in zip(edges["hub"], edges["row"], edges["own"]):
        asks.setdefault(row, []).append(hub)
        if own:
            gives.setdefault(row, []).append(hub)
    out = []
    for row in sorted(asks):
        a = min((taken[h] for h in asks[row] if h in taken), default=row)
        if a == row:
            for h in gives.get(row, ()):
                taken.setdefault(h, row)
        out.append((row, a))
    yield pd.DataFrame(out, columns=["row", "a"])


def carried(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` marked for broadcast if that many rows of that width are few enough, else as it is."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def _union(of: list[DataFrame]) -> DataFrame:
    out = of[0]
    for more in of[1:]:
        out = out.unionByName(more)
    return out


def _told_once(pairs: list[DataFrame]) -> DataFrame:
    """All ``pairs``, smaller id first, each once."""
    return _union(pairs).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()


def _carried_parts(keys: DataFrame, key: str, rows: int, width: int) -> list[DataFrame]:
    """``keys`` in parts small enough to be carried, if four are enough; else as they are."""
    parts = max(1, -(-rows * width // BROADCAST_BYTES))
    if parts > 4:
        return [keys]
    return [F.broadcast(keys.where(F.pmod(key, F.lit(parts)) == i) if parts > 1 else keys) for i in range(parts)]


def repeats(spark: SparkSession, items: DataFrame, order: str, site_names: frozenset[str], shares: tuple[float, ...] = (0.75,), path: str | None = None) -> DataFrame:
    """All of ``items`` (row_id, title, url and the rising ``order``), ingested in blocks as they would arrive: the first up to
    the first of ``shares`` of the batches, and so on. A row without ``order`` goes to the block that its row_id falls into.

    Without ``path`` the index is removed at the end.
    """
    index = HistoryIndex(spark, site_names, path)
    cuts = sorted(set(items.approxQuantile(order, list(shares), 0.01))) if shares else []
    tops = list(items.agg(*[F.max(F.when(F.col(order) <= c, F.col("row_id"))) for c in cuts]).first()) if cuts else []
    within = lambda c, a, b: (F.col(c) > a if a is not None else F.lit(True)) & (F.col(c) <= b if b is not None else F.lit(True))
    out, low, under = None, None, None
    for high, top in [*zip(cuts, tops), (None, None)]:
        got = index.ingest(items.where(F.when(F.col(order).isNull(), within("row_id", under, top)).otherwise(within(order, low, high))))
        out = got if out is None else out.unionByName(got)
        low, under = high, top
    if path is None:
        discard(spark, index.path)
    return out

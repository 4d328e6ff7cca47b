"""Values that were cut off, by a backward character n-gram model.

The model holds, for contexts of 1 to 20 characters read backwards from a position (the short ones once more together
with how the line opens), how often a line ended there and how often it went on. A line's first sentence also ends at its
full stop, as headings and notes are such sentences without one; a paragraph of several sentences only ends as a line. It is counted over every position of every text, but only for contexts in which some value ends (a
bitmap of fixed size tells which), so its size follows the number of values, not of characters. The end of a value is
judged by the log-odds of ending against going on, interpolated from short to long contexts. Thresholds are set per
language and column, where the log-odds of the group part best.

A mark of omission is evidence of a cut that outweighs any context, a full stop (with quotes or brackets after it) ends a
value. Lengths at which far more values
stop than around it are limits; there the model need only lean towards a cut. Null, empty and blank values are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_small, materialize

ORDERS = (1, 2, 3, 4, 6, 8, 12, 16, 20)
#: Characters before the position that are read together with how the line opens, and characters of that opening.
WITH_OPENING, OPENING = (1, 3), 5
BITMAP = 1 << 26
#: Weight of the shorter context in the longer one.
BACK_OFF = 2.0
#: Bounds of a threshold, the one used where nothing can be parted, and the size below which a group is pooled with its column.
LOW, HIGH, USUAL, GROUP = -4.0, -0.7, -1.5, 200
#: What a mark of omission takes off the log-odds: more than any context gives.
MARK = 10.0
#: Log-odds below which a value that stops at a limit is cut.
LEAN = 0.0
_DONE = re.compile(r"[.!?。！？؟‽⸮][\"”»’'）)」』】\]*_]*$")
_MARK = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\)|⋯)[\"”»’)」』]*$")
_INNER = re.compile(r"[.!?][\"”»’)]*\s+(?=[^a-zà-ÿ\s])|[。！？][”’」』]*(?=.)")
_STOP = re.compile(r"[.!?](?=[\"”»’)]*(?:\s|$))|[。！？]")
_MARKER = re.compile(r"^\s*(?:[-*+>]|#{1,6}|\d+[.)])\s+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.uint64(0xD6E8FEB86659FD93)


class Reader:
    """The contexts (``ORDERS``, then ``WITH_OPENING``) before each position 1..len of a text of several lines, as hashes.

    After the first whole sentence of a line contexts are of another class: a paragraph seldom ends without a full
    stop, a heading does. The lowest bit of a hash is left free.
    """

    def __init__(self, text: str) -> None:
        self.chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(self.chars)
        starts = np.zeros(n, dtype=np.int64)
        breaks = np.flatnonzero(self.chars == 10) + 1
        starts[breaks[breaks < n]] = breaks[breaks < n]
        self.starts = np.maximum.accumulate(starts)
        sentence = np.full(n, -1, dtype=np.int64)
        ends = np.fromiter((m.end() for m in _INNER.finditer(text)), dtype=np.int64)
        sentence[ends[ends < n]] = ends[ends < n]
        self.later = np.where(np.maximum.accumulate(sentence) > self.starts, _CLASS, np.uint64(0))
        with np.errstate(over="ignore"):
            c = self.chars.astype(np.uint64) * _PRIME
            c ^= c >> np.uint64(29)
            self.power = {1: c}
            for k in (2, 4):  # hash of the k characters that end at a position
                self.power[k] = _after(self.power[k // 2], self.power[k // 2], k // 2)

    def _run(self, k: int, at: np.ndarray) -> np.ndarray:
        """The hash of the ``k`` characters that end at the positions ``at``, as far as the text reaches back."""
        if k in self.power:
            return np.where(at >= 0, self.power[k][np.maximum(at, 0)], np.uint64(0))
        near = 1 << (k.bit_length() - 1)
        if near == k:
            near //= 2
        return self._run(near, at) + self._run(k - near, at - near) * np.uint64(pow(int(_PRIME), near, 1 << 64))

    def at(self, i: int, at: np.ndarray) -> np.ndarray:
        """The hash of context ``i`` at the positions ``at``."""
        with np.errstate(over="ignore"):
            if i < len(ORDERS):
                h = self._run(ORDERS[i], at)
            else:
                opening = self._run(OPENING, np.minimum(self.starts[at] + OPENING - 1, len(self.chars) - 1))
                h = self._run(WITH_OPENING[i - len(ORDERS)], at) ^ opening * _CLASS
            h = (h ^ np.uint64(i + 1)) * _PRIME ^ self.later[at]
            return (h ^ h >> np.uint64(31)) & ~np.uint64(1)


#: Per context the shorter one it goes on from: where that was never asked for, neither was this.
WITHIN = [None, *range(len(ORDERS) - 1), 0, len(ORDERS)]


def contexts(text: str) -> list[int]:
    """The hashes of all contexts at the end of a text."""
    read, end = Reader(text), np.array([len(text) - 1])
    return [int(read.at(i, end)[0].astype(np.int64)) for i in range(len(WITHIN))]


def _after(near: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """The hash of ``near`` (k characters long) with ``far`` before it."""
    out = near.copy()
    out[k:] += far[: max(0, len(far) - k)] * np.uint64(pow(int(_PRIME), k, 1 << 64))
    return out


def plain(line: str) -> str:
    """A line as the model reads it: without its mark of structure, digits alike."""
    return re.sub(r"\d", "0", _MARKER.sub("", line.rstrip()))


def whole(value: str) -> str:
    """A value as the model reads it."""
    return "\n".join(plain(r) for r in value.rstrip().split("\n") if r.strip())


def open_end(value: str | None) -> str | None:
    """The end of a value that stops without a full stop, as the model reads it; else None. Its mark of omission is no text."""
    value = _MARK.sub("", (value or "").rstrip()).rstrip() if value and _MARK.search(value.rstrip()) else value
    if not value or not value.strip():
        return None
    last = value.rstrip().rsplit("\n", 1)[-1]
    if _DONE.search(last) or last.lstrip().startswith("```"):
        return None
    last = plain(last)
    before = whole(value[: -len(value.rstrip().rsplit("\n", 1)[-1])].rstrip()[-200:]) if "\n" in value.strip() else ""
    return f"\n{before[-40:]}\n{last}" if last else None


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(1) & np.uint64(BITMAP - 1)).astype(np.int64)


def cut_values(values: DataFrame, headlines: DataFrame | None = None) -> DataFrame:
    """Judges ``values`` (tbl, rec_no, lang, text): tbl, rec_no, ``log_odds``, ``reason`` (mark, model, limit).

    ``headlines`` (text), if given, are whole lines that the model learns from as well, without being judged.
    """
    spark = values.sparkSession

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for tbl, rec, lang, text in zip(df["tbl"], df["rec_no"], df["lang"], df["text"]):
                mark = bool(text and _MARK.search(text.rstrip()))
                line = open_end(text)
                if mark or line is not None:
                    out.append((tbl, rec, lang, len(text), mark, contexts(line) if line else []))
            yield pd.DataFrame(out, columns=["tbl", "rec_no", "lang", "size", "mark", "h"])

    open_ = materialize(values.select("tbl", "rec_no", "lang", "text").mapInPandas(ends, "tbl string, rec_no long, lang string, size int, mark boolean, h array<long>"), "ends")
    asked = open_.select("tbl", "rec_no", F.posexplode("h").alias("k", "h"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = [np.empty(0, np.int64)]
        for df in batches:
            at.append(_slots(df["h"].to_numpy(dtype=np.int64).astype(np.uint64)))
        at = np.unique(np.concatenate(at))
        word = at >> 6
        i, start = np.unique(word, return_index=True)
        b = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start) if len(at) else np.empty(0, np.uint64)
        yield pd.DataFrame({"i": i.astype(np.int32), "b": b.astype(np.int64)})

    got = asked.select("h").mapInPandas(bits, "i int, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(BITMAP >> 6, dtype=np.uint64)
    bitmap[got["i"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64).astype(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        held = []

        def flush() -> pd.DataFrame:
            x = np.sort(np.concatenate(held))  # the lowest bit tells whether the line ended
            h = x & ~np.uint64(1)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n, end = np.diff(np.r_[first, len(x)]), np.add.reduceat((x & np.uint64(1)).astype(np.int64), first)
            return pd.DataFrame({"h": h[first].astype(np.int64), "ended": end, "went_on": n - end})

        size = 0
        for df in batches:
            # a headline stands as a line of its own before an empty end, which is asked and doesn't count
            texts = [whole(t) + ("\n" if h else "") for t, h in zip(df["text"], df["whole"]) if t and t.strip() and not (h and _MARK.search(t.rstrip()))]
            for some in range(0, len(texts), 60):
                part = texts[some : some + 60]
                joined = "\n" + "\n".join(part)
                # the line ends where a value itself ends are what is asked, so they don't count
                own = np.cumsum([len(t) + 1 for t in part]) - 1
                read = Reader(joined)
                ended = np.zeros(len(joined), dtype=np.uint64)
                ended[:-1] = read.chars[1:] == 10
                # within a line's first sentence a full stop ends it as a line's end does: headings do without
                ended[np.fromiter((m.start() - 1 for m in _STOP.finditer(joined) if m.start() and not read.later[m.start() - 1]), dtype=np.int64)] = 1
                use = read.chars != 10
                use[own] = False
                use = np.flatnonzero(use)
                hits: list[np.ndarray] = []
                for i, before in enumerate(WITHIN):
                    at = use if before is None else hits[before]
                    h = read.at(i, at)
                    s = _slots(h)
                    hit = (bitmap[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    hits.append(at[hit])
                    if len(hits[-1]):
                        held.append(h[hit] | ended[hits[-1]])
                        size += len(hits[-1])
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    read = values.select("text", F.lit(False).alias("whole"))
    if headlines is not None:
        read = read.unionByName(headlines.select("text", F.lit(True).alias("whole")))
    counts = read.mapInPandas(count, "h long, ended long, went_on long").groupBy("h").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on"))
    seen = asked.join(counts, "h").groupBy("tbl", "rec_no").agg(F.sort_array(F.collect_list(F.struct("k", "ended", "went_on"))).alias("c"))
    p = F.expr(f"aggregate(c, 0.5D, (p, x) -> (x.ended + {BACK_OFF}D * p) / (x.ended + x.went_on + {BACK_OFF}D))")
    judged = open_.join(seen, ["tbl", "rec_no"], "left").withColumn("_p", F.coalesce(p, F.lit(0.5)))
    odds = F.log((F.col("_p") + 1e-4) / (1 - F.col("_p") + 1e-4)) - F.when(F.col("mark"), F.lit(MARK)).otherwise(F.lit(0.0))
    judged = materialize(judged.select("tbl", "rec_no", "lang", "size", "mark", odds.alias("log_odds")), "odds")
    bins = judged.where("not mark").groupBy("tbl", "lang", F.round(F.col("log_odds") * 4).cast("int").alias("b")).count().collect()  # at most some 80 bins a group
    limits = [(t, g, float(x)) for (t, g), x in thresholds([(r["tbl"], r["lang"], r["b"], r["count"]) for r in bins]).items()]
    table = spark.createDataFrame(limits or [("", "", 0.0)], "tbl string, lang string, _limit double")
    sizes = judged.where("not mark and log_odds < 0").groupBy("tbl", "size").count()
    near = sizes.select("tbl", F.explode(F.sequence(F.col("size") - 12, F.col("size") + 12)).alias("size"), F.col("count").alias("n")).groupBy("tbl", "size").agg(F.sum("n").alias("_around"))
    spikes = sizes.join(near, ["tbl", "size"]).where("count >= 8 and count >= 0.5 * _around").select("tbl", "size", F.lit(True).alias("_spike"))
    out = join_small(judged, spikes, ["tbl", "size"]).join(F.broadcast(table), (judged["tbl"] == table["tbl"]) & judged["lang"].eqNullSafe(table["lang"]), "left").drop(table["tbl"], table["lang"])
    by_model = F.col("log_odds") < F.coalesce("_limit", F.lit(USUAL))
    reason = F.when(by_model, F.when(F.col("mark"), "mark").otherwise("model")).when(F.col("_spike") & (F.col("log_odds") < LEAN), "limit")
    return out.select("tbl", "rec_no", "log_odds", reason.alias("reason")).where(F.col("reason").isNotNull())


def thresholds(bins: list[tuple[str, str | None, int, int]]) -> dict[tuple[str, str | None], float]:
    """Per (column, language) the log-odds that part the group best (least variance within), within ``LOW`` and ``HIGH``.

    A group of fewer than ``GROUP`` values takes the threshold of its whole column.
    """
    groups: dict[tuple[str, str | None], dict[int, int]] = {}
    pooled: dict[str, dict[int, int]] = {}
    for tbl, lang, b, n in bins:
        groups.setdefault((tbl, lang), {})[b] = n
        column = pooled.setdefault(tbl, {})
        column[b] = column.get(b, 0) + n
    out = {}
    for key, hist in groups.items():
        if sum(hist.values()) < GROUP:
            hist = pooled[key[0]]
        x = np.array(sorted(hist), dtype=float)
        w = np.array([hist[int(b)] for b in x], dtype=float)
        if len(x) < 4:
            out[key] = USUAL
            continue
        best, at = -1.0, USUAL
        for i in range(1, len(x)):
            cut = (x[i - 1] + x[i]) / 8
            if not LOW <= cut <= HIGH:
                continue
            a, b = w[:i].sum(), w[i:].sum()
            apart = a * b * ((x[:i] * w[:i]).sum() / a - (x[i:] * w[i:]).sum() / b) ** 2
            if apart > best:
                best, at = apart, cut
        out[key] = at
    return out


def rates(values: DataFrame, cut: DataFrame) -> DataFrame:
    """Per table and source: values that are not blank, cut ones, and their share. ``values`` has tbl, rec_no, source, text."""
    full = values.where(F.trim("text") != "").join(cut.select("tbl", "rec_no", F.lit(1).alias("_cut")).distinct(), ["tbl", "rec_no"], "left")
    out = full.groupBy("tbl", "source").agg(F.count("*").alias("n_values"), F.count("_cut").alias("n_cut"))
    return out.withColumn("cut_share", F.col("n_cut") / F.col("n_values"))

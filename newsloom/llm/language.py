"""The language of texts and of their sentences, by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (1 to 4) of a language, in order. A sentence's own n-grams,
in order of frequency, are compared with every profile by the sum of how far each is out of place; an n-gram that a
profile lacks costs the most. The nearest profile names the language, the distance to the next one the confidence.
Profiles are fitted on a bounded sample of labelled texts (``TRAIN_TEXTS`` a language).

Sentences that are too short, and text that is code, an address or a menu, have no language of their own. A sentence of
low confidence takes the language of the text around it. Null and empty texts have no language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("en", "zh", "de", "fr", "es", "pt", "ja")
#: N-grams of a profile. Scripts without blanks have thousands of letters, so all profiles are long.
PROFILE = 4_000
#: Letters a sentence needs (of alphabets, of scripts without blanks).
LETTERS, SIGNS = 24, 8
#: Confidence from which a sentence stands on its own; below, it takes the language around it.
SURE = 0.25
#: Labelled texts per language that the profiles are fitted on (those with the smallest hash).
TRAIN_TEXTS = 400
#: Share of a sentence's n-grams that its profile must know.
KNOWN = 0.4
# fixed values: names under which a label may state a language (codes of ISO 639, and names)
LABELS = {
    "en": "en eng english anglais englisch inglés inglês 英语 英文",
    "zh": "zh zho chi cn chinese mandarin cmn 中文 汉语 简体中文 繁体中文 zh-hans zh-hant",
    "de": "de deu ger german deutsch allemand alemán",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano spanisch",
    "pt": "pt por portuguese português portugues portugiesisch",
    "ja": "ja jpn jp japanese 日本語 nihongo",
}
_LABEL = {name: lang for lang, names in LABELS.items() for name in names.split()}
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”»’)]*\s+(?=[^a-zà-ÿ\s])|(?<=[。！？])(?![”’」』）\"])|(?<=[。！？][”’」』）\"])")
_DROP = re.compile(r"`[^`\n]*`|https?://\S+|\w+@\S+|“[^”]{1,60}”|«[^»]{1,60}»|「[^」]{1,30}」|„[^“”]{1,60}[“”]|\d[\d.,%]*")
_WHOLE = re.compile(r"[.!?。！？][\"”»’)」』）]*\s*$")
_NO_LETTER = re.compile(r"[^\w'’]|[\d_]")
_SIGN = re.compile(r"[぀-ヿ㐀-鿿]")


def stated(label: str | None) -> str | None:
    """The language a label states, in any notation; None where it states none."""
    if not label:
        return None
    plain = unicodedata.normalize("NFKC", label).strip().casefold().replace("_", "-")
    return _LABEL.get(plain) or _LABEL.get(re.split(r"[-\s(;,]", plain)[0])


def letters(sentence: str) -> str:
    """A sentence as its words, one blank between; only letters count."""
    return " ".join(_NO_LETTER.sub(" ", _DROP.sub(" ", sentence).casefold()).split())


def ngrams(plain: str) -> Counter:
    s = f" {plain} "
    return Counter(s[i : i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1) if s[i : i + n] != " ")


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(start, sentence) of a text's prose; code lines and marks of structure are left out."""
    at, code = 0, False
    for line in text.split("\n"):
        if _FENCE.match(line):
            code = not code
        elif not code and line.strip():
            here = at + len(line) - len(line.lstrip(" \t#>*-"))
            body = line.lstrip(" \t#>*-")
            last = 0
            for m in _SPLIT.finditer(body):
                if m.start() > last:
                    yield here + last, body[last : m.start()]
                last = m.end()
            if last < len(body):
                yield here + last, body[last:]
        at += len(line) + 1


def hashed(text: str) -> list[np.ndarray]:
    """Per length 1 to 4 the hash of the n-gram that ends at each character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for n in range(4):
            before = np.concatenate([np.zeros(min(n, len(c)), np.uint64), c[: max(0, len(c) - n)]])
            h = h * np.uint64(0x100000001B3) + before * np.uint64(0x9E3779B97F4A7C15)
            x = h ^ (h >> np.uint64(31)) ^ np.uint64(n + 1)
            out.append(x * np.uint64(0xBF58476D1CE4E5B9))
    return out


class Profiles:
    """Rank-order profiles of ``LANGS``: a row of ranks per n-gram, ``PROFILE`` where a language lacks it.

    N-grams are looked up in a table of slots (hash, row); the few whose slot is taken lie in a sorted rest.
    """

    SLOTS = 1 << 18

    def __init__(self, ranks: dict[str, dict[str, int]]) -> None:
        grams = sorted({g for r in ranks.values() for g in r})
        self.langs = [x for x in LANGS if x in ranks]
        hashes = np.array([hashed(g)[len(g) - 1][-1] for g in grams], dtype=np.uint64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        row = {grams[i]: n for n, i in enumerate(order)}
        # the last row is for n-grams that no profile has
        self.ranks = np.full((len(self.langs), len(grams) + 1), PROFILE, dtype=np.float32)
        for j, lang in enumerate(self.langs):
            for g, r in ranks[lang].items():
                self.ranks[j, row[g]] = r
        self.none = len(grams)
        self.key = np.zeros(self.SLOTS, dtype=np.uint64)
        self.row = np.full(self.SLOTS, self.none, dtype=np.int32)
        slot = (hashes >> np.uint64(46)).astype(np.int64)
        kept = np.zeros(len(hashes), bool)
        kept[np.unique(slot, return_index=True)[1]] = True
        self.key[slot[kept]], self.row[slot[kept]] = hashes[kept], np.flatnonzero(kept)
        self.rest, self.rest_row = hashes[~kept], np.flatnonzero(~kept).astype(np.int32)
        self.shared = np.zeros(self.SLOTS, bool)
        self.shared[slot[~kept]] = True

    def rows(self, h: np.ndarray) -> np.ndarray:
        """The row of every hash, the last one for hashes that no profile has."""
        slot = (h >> np.uint64(46)).astype(np.int64)
        row = np.where(self.key[slot] == h, self.row[slot], self.none).astype(np.int32)
        if len(self.rest):
            more = np.flatnonzero(self.shared[slot] & (row == self.none))
            at = np.searchsorted(self.rest, h[more])
            at[at >= len(self.rest)] = 0
            hit = self.rest[at] == h[more]
            row[more[hit]] = self.rest_row[at[hit]]
        return row

    def nearest(self, found: list[str]) -> list[tuple[str | None, float]]:
        """The language of every sentence and the confidence (0 to 1); None where it has too few letters or is unlike all.

        An n-gram that no profile has is out of place in all languages alike; each of its occurrences counts once.
        """
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(found)
        plain, which = [], []
        for k, s in enumerate(map(letters, found)):
            signs = 0 if s.isascii() else len(_SIGN.findall(s))
            if signs >= SIGNS or len(s) - s.count(" ") - signs >= LETTERS:
                plain.append(f" {s} ")
                which.append(k)
        if not plain or not self.langs:
            return out
        text = "".join(plain)
        size = np.array([len(s) for s in plain])
        sid = np.repeat(np.arange(len(plain), dtype=np.int32), size)
        since = np.arange(len(text), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        blank = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32
        keys, unknown, width = [], np.zeros(len(plain), np.int64), self.none + 1
        for n, x in enumerate(hashed(text)):
            row = self.rows(x)
            ok = since >= n
            if n == 0:
                ok &= ~blank
            lost = ok & (row == self.none)
            unknown += np.bincount(sid[lost], minlength=len(plain))
            ok &= row != self.none
            keys.append(sid[ok].astype(np.int64) * width + row[ok])
        keys = np.sort(np.concatenate(keys))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(first)
        count = np.diff(np.append(first, len(keys)))
        at, row = np.divmod(keys[first], width)
        # n-grams of one frequency share a place: the number of those that are more frequent
        most = int(count.max()) + 1 if len(count) else 1
        if most * len(plain) > 50_000_000:  # a very long sentence: its frequencies are ranked first, so the table stays small
            count = np.unique(count, return_inverse=True)[1] + 1
            most = int(count.max()) + 1
        of = at * most + count
        freq = np.bincount(of, minlength=len(plain) * most).reshape(len(plain), most)
        above = freq[:, ::-1].cumsum(axis=1)[:, ::-1] - freq
        place = above.ravel()[of].astype(np.float32)
        size = np.bincount(at, minlength=len(plain))
        there = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[there]
        far = np.zeros((len(self.langs), len(plain)), np.float64)
        known = np.zeros((len(self.langs), len(plain)), np.int64)
        for j, ranks in enumerate(self.ranks if len(starts) else ()):
            r = ranks[row]
            d = np.abs(r - place)
            lacks = r >= PROFILE
            np.minimum(d, PROFILE, out=d)
            d[lacks] = PROFILE
            far[j, there] = np.add.reduceat(d, starts, dtype=np.float64)
            known[j, there] = size[there] - np.add.reduceat(lacks, starts, dtype=np.int64)
        total = size + unknown
        far += unknown * float(PROFILE)
        by = np.argsort(far, axis=0, kind="stable")
        for n, k in enumerate(which):
            best = by[0, n]
            if known[best, n] >= KNOWN * total[n]:
                second = far[by[1, n], n] if len(self.langs) > 1 else float(PROFILE) * total[n]
                out[k] = (self.langs[best], float((second - far[best, n]) / max(second, 1.0)))
        return out

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float, int]]]:
        """Per text the (start, end, language, confidence, whole sentences) of its sentences, neighbours of one language joined."""
        found = [list(sentences(t)) if t else [] for t in texts]
        asked = list(dict.fromkeys(s for f in found for _, s in f))  # a sentence is ranked once, however often it stands
        told = dict(zip(asked, self.nearest(asked)))
        return [self._join([(at, s, *told[s]) for at, s in f]) for f in found]

    @staticmethod
    def _join(found: list[tuple[int, str, str | None, float]]) -> list[tuple[int, int, str, float, int]]:
        sure: Counter = Counter()
        for _, s, lang, conf in found:
            if lang:
                sure[lang] += conf * len(s)
        main = sure.most_common(1)[0][0] if sure else None
        out: list[tuple[int, int, str, float, int]] = []
        for at, s, lang, conf in found:
            if lang is None:
                continue
            whole = bool(_WHOLE.search(s))
            if lang != main and (conf < SURE or not whole):
                lang = main
            if out and out[-1][2] == lang:
                a, e, _, c, n = out[-1]
                out[-1] = (a, at + len(s), lang, (c * (e - a) + conf * len(s)) / max(1, e - a + len(s)), n + whole)
            else:
                out.append((at, at + len(s), lang, conf, int(whole)))
        return out


def train(texts: DataFrame, text: str, lang: str) -> Profiles:
    """Profiles from labelled texts; at most ``PROFILE`` n-grams a language reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for df in batches:
            for lang_, body in zip(df["_lang"], df["_text"]):
                if body and lang_ in LANGS:
                    for _, s in sentences(body):
                        seen[lang_].update(ngrams(letters(s)))
        out = [(lang_, g, n) for lang_, c in seen.items() for g, n in c.items()]
        yield pd.DataFrame(out, columns=["lang", "g", "n"])

    texts = texts.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where(F.col("_lang").isin(*LANGS) & (F.length("_text") > 0))
    pick = texts.withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_text"), "_text"))).where(F.col("_r") <= TRAIN_TEXTS)
    rows = pick.select("_lang", "_text").mapInPandas(count, "lang string, g string, n long")
    counts = rows.groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("r") <= PROFILE)
    ranks: dict[str, dict[str, int]] = defaultdict(dict)
    for r in top.collect():
        ranks[r["lang"]][r["g"]] = r["r"] - 1
    return Profiles(ranks)


def label_segments(texts: DataFrame, keys: list[str], text: str, profiles: Profiles) -> DataFrame:
    """Per text its segments: ``keys``, ``seg_no``, ``start_pos`` (from 1), ``end_pos``, ``lang``, ``confidence``, ``n_whole``."""
    shared = texts.sparkSession.sparkContext.broadcast(profiles)
    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at in range(0, len(df), 60):  # few enough that the arrays stay in the cache
                part = df.iloc[at : at + 60]
                out = []
                for row, segs in zip(part.itertuples(index=False), shared.value.segments(list(part["_text"]))):
                    for n, (a, e, lang, c, whole) in enumerate(segs):
                        out.append((*row[:-1], n, a + 1, e, lang, c, whole))
                yield pd.DataFrame(out, columns=[*keys, "seg_no", "start_pos", "end_pos", "lang", "confidence", "n_whole"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", seg_no int, start_pos int, end_pos int, lang string, confidence double, n_whole int"
    return texts.select(*keys, F.col(text).alias("_text")).mapInPandas(label, schema)


def document_language(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The main language of every text, by length, with its share as confidence."""
    size = segments.groupBy(*keys, F.col("lang").alias("_lang")).agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("_n"))
    whole = size.groupBy(*keys).agg(F.max_by(F.struct("_lang", "_n"), F.struct("_n", "_lang")).alias("_m"), F.sum("_n").alias("_all"))
    return whole.select(*keys, F.col("_m._lang").alias("lang"), (F.col("_m._n") / F.col("_all")).alias("confidence"))


def stated_column(label: Column) -> Column:
    """``stated`` as a column expression, from the same table of names."""
    plain = F.regexp_replace(F.lower(F.trim(label)), "_", "-")
    table = F.create_map(*[F.lit(x) for k, v in _LABEL.items() for x in (k, v)])
    return F.coalesce(table[plain], table[F.regexp_extract(plain, r"^([^-\s(;,]*)", 1)])

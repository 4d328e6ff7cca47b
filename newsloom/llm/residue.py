"""Template residue, filler, error pages and notices, found by labelled exemplars.

The exemplars sit in an inverted index (token to exemplars, a table of fixed size). Every line of a text, cut into
sentences and windows, retrieves the exemplars that share a token with it and is compared by TF-IDF containment both
ways: how much of the exemplar the window holds, and how much of the window the exemplar covers. Weights come from the
document frequencies of the index's tokens over all texts. A slot in the delimiters of a template language is a window
of its own, whose token names the delimiters; it is retrieved and compared as any other window.

The filing makes sure that any window which holds the wanted share of an exemplar has a token it is filed under; a text or
line that as a whole holds too little of every exemplar it retrieves is not cut up.

Code (fences and back-ticks) and quotations are left out: a text may show or quote such strings. Placeholders and
filler count anywhere; error pages and notices count only if they make up most of what the text holds. Null and empty
texts hold nothing and are no case.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exemplars import CAPITAL_DELIMITERS, DELIMITERS, EXEMPLARS

#: Share of an exemplar's weight that a window must hold, and of a window's weight that the exemplar must cover.
HOLDS, COVERS = 0.62, 0.6
#: Share of a text's words that must be matched for an error page or a notice.
MOST = 0.5
WINDOW = 40

_NAME = r"\s*[\w.\-]+(?:\s*[|:/]\s*[\w.\-]+)*\s*"
_CODE_NAME = r"\s*[\w.]+(?:[ :|/.\-]+(?:\w+|\"[^\"]*\"|'[^']*'))*\s*"
_SHAPES = [(f"{a}…{b}", re.compile(re.escape(a) + _CODE_NAME + re.escape(b))) for a, b in DELIMITERS]
_CAPS = [(f"{a}N{b}", re.compile((r"(?<![\w" + re.escape(a) + "])" if a.isalpha() is False else r"\b") + re.escape(a) + r"\s*(?:[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)*|[a-z]+(?:_[a-z0-9]+)+)\s*" + re.escape(b))) for a, b in CAPITAL_DELIMITERS]
_TOKEN = re.compile(r"⟦[^⟧]*⟧|[぀-ヿ㐀-鿿]+|[^\W\d_぀-ヿ㐀-鿿]+|\w*\d\w*")
#: Runs of the letters that the exemplars are written in, beside signs; a token of theirs is such a run wherever it stands alone.
_ALPHA = re.compile("[a-zß-öø-ÿ" + "".join(sorted({c for _, t in EXEMPLARS for c in t.casefold() if c.isalpha() and not "぀" <= c <= "鿿"})) + "]+")
_SIGNS = re.compile(r"[぀-ヿ㐀-鿿]+")
#: What a slot opens with, and its pattern: the pattern is tried only where the opening stands.
_OPENERS = [(d[0], p) for d, (_, p) in zip(DELIMITERS + CAPITAL_DELIMITERS, _SHAPES + _CAPS) if len(d[0]) > 1]
_OPENER = re.compile("[" + re.escape("".join(sorted({a for a, _ in CAPITAL_DELIMITERS if len(a) == 1}))) + r"]\s*(?:[A-Z]|[a-z]+_)")
#: The name of a field within a note in brackets: a slot's own name tells nothing.
_FIELD = re.compile(r"\b[^\W\d]\w*(?:[._][^\W\d]\w*)+\b")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_QUOTED = re.compile(r"“[^”\n]{1,200}”|«[^»\n]{2,200}»|„[^“”\n]{1,200}[“”]|「[^」\n]{1,200}」|『[^』\n]{1,200}』|(?<!\w)\"[^\"\n]{1,200}\"(?!\w)|‘[^’\n]{1,80}’")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_NOTE = re.compile(r"[\[【［(]([^\[\]【】［］()\n]{2,40})[\]】］)]")


def shapes(line: str) -> str:
    """``line`` with every placeholder of a template language as one token that names its delimiters."""
    for name, pattern in _SHAPES:
        line = pattern.sub(f" ⟦{name}⟧ ", line)
    for name, pattern in _CAPS:
        line = pattern.sub(f" ⟦{name}⟧ ", line)
    return line


def slotted(text: str) -> bool:
    """Whether a text may hold a slot: it has what a slot opens with."""
    return any(a in text and p.search(text) for a, p in _OPENERS) or _OPENER.search(text) is not None


def tokens(line: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(shapes(line) if slotted(line) else line):
        if t.isalpha():
            if "぀" <= t[0] <= "鿿":
                out.extend(t[i : i + 2] for i in range(max(1, len(t) - 1)))
            else:
                out.append(t.casefold())
        else:
            out.append(t if t[0] == "⟦" else "0")
    return out


def words(text: str) -> set[str]:
    """The distinct tokens of a text that an exemplar may be filed under, slots and numbers aside."""
    out = set(_ALPHA.findall(text.casefold()))
    if not text.isascii():
        for run in _SIGNS.findall(text):
            out.update(run[i : i + 2] for i in range(max(1, len(run) - 1)))
    return out


def prose_lines(body: str) -> list[str]:
    """The lines of a text outside code fences, without back-ticked spans and quotations."""
    out, code = [], False
    for line in body.split("\n"):
        if _FENCE.match(line):
            code = not code
            continue
        if not code and line.strip():
            line = re.sub(r"`[^`\n]*`", " ", line)
            # a quotation that is the whole line, or holds a bare placeholder name, is no quotation
            kept = _QUOTED.sub(lambda m: m.group() if len(m.group()) > 0.8 * len(line.strip()) or re.fullmatch(r"«\s*[A-Z][A-Z0-9_]*\s*»", m.group()) else " ", line)
            out.append(kept.strip())
    return out


class Index:
    """The inverted index of the exemplars; ``weigh`` sets the weights from document frequencies.

    An exemplar is filed under its heaviest tokens only: as many as make sure that any window which holds the wanted
    share of its weight has one of them.
    """

    def __init__(self) -> None:
        # a slot's exemplar is the token that names its delimiters
        slots = [f"⟦{a}…{b}⟧" for a, b in DELIMITERS] + [f"⟦{a}N{b}⟧" for a, b in CAPITAL_DELIMITERS]
        self.texts = [t for _, t in EXEMPLARS] + slots
        self.kinds = [k for k, _ in EXEMPLARS] + ["placeholder"] * len(slots)
        self.noted = [t[0] in "[【［(" for t in self.texts]  # a note in brackets matches only a note in brackets
        self.sets = [{t} if t[0] == "⟦" else set(tokens(t)) - {"0"} or set(tokens(t)) for t in self.texts]
        self.vocabulary = frozenset(t for s in self.sets for t in s)

    def weigh(self, df: dict[str, int], n: int) -> Index:
        self.weight = {t: math.log((n + 1) / (df.get(t, 0) + 0.5)) + 0.1 for t in self.vocabulary}
        self.other = math.log((n + 1) / 1.5) * 0.5 + 0.1
        self.full = [sum(self.weight[t] for t in s) for s in self.sets]
        self.post: dict[str, list[int]] = defaultdict(list)
        for i, s in enumerate(self.sets):
            long = self.kinds[i] == "filler" and len(s) > 12
            slack, left = (0.45 if self.kinds[i] == "placeholder" else 1 - HOLDS) * self.full[i], 0.0
            for t in sorted(s, key=lambda t: (-self.weight[t], t)):
                if long and len(t) < 5:
                    continue
                self.post[t].append(i)
                left += self.weight[t]
                if left > slack and not long:
                    break
        self.filed = frozenset(self.post)
        return self

    def best(self, window: list[str], noted: bool = False) -> tuple[str, str] | None:
        """Kind and text of the exemplar that matches a window, None if none does."""
        have = set(window)
        near = {i for t in have for i in self.post.get(t, ())}
        if not near:
            return None
        total = sum(self.weight.get(t, self.other) for t in have if t != "0") or 1.0
        found = None
        for i in sorted(near):
            k = self.kinds[i]
            if self.noted[i] and not noted:
                continue
            w = sum(self.weight[t] for t in have & self.sets[i])
            if k == "placeholder":
                # a slot's own name may fill the rest of a note
                if w >= 0.55 * self.full[i] and w >= 0.6 * total:
                    return k, self.texts[i]
            elif k == "filler":
                if (w >= HOLDS * self.full[i] or (len(self.sets[i]) > 12 and len(have) >= 4)) and w >= COVERS * total:
                    found = k, self.texts[i]
            elif found is None and w >= HOLDS * self.full[i] and w >= COVERS * total:
                found = k, self.texts[i]
        return found

    def reachable(self, have: set[str]) -> set[str]:
        """The tokens of a text under which an exemplar is filed of which some window can hold enough."""
        out = set()
        for t in have & self.filed:
            for i in self.post[t]:
                both = have & self.sets[i]
                if self.kinds[i] == "filler" and len(self.sets[i]) > 12:
                    ok = len(both) >= 2
                else:
                    ok = sum(self.weight[x] for x in both) >= (0.55 if self.kinds[i] == "placeholder" else HOLDS) * self.full[i]
                if ok:
                    out.add(t)
                    break
        return out

    def judge(self, body: str | None) -> tuple[str, str] | None:
        """The kind of residue a text is or holds (placeholder, filler, error, gate) and the exemplar; None if it is sound."""
        if not body or not (near := self.reachable(words(body))) and not slotted(body):
            return None
        matched: Counter = Counter()
        by: dict[str, str] = {}
        lines = prose_lines(body)
        some = slotted(body)
        for line in lines:
            slots = some and slotted(line)
            if not slots:
                folded = line.casefold()
                if not any(t in folded for t in near) or not self.reachable(words(line)):
                    continue
            if slots:
                for t in _TOKEN.findall(shapes(line)):
                    if t[0] == "⟦" and (got := self.best([t])):
                        return got
            for m in _NOTE.finditer(line):
                got = self.best(tokens(_FIELD.sub(" 0 ", m.group())), True)
                if got and got[0] == "placeholder":
                    return got
            whole = tokens(line)
            if len(whole) <= WINDOW and (got := self.best(whole)):
                matched[got[0]] += len(whole)
                by.setdefault(*got)
                continue
            for sentence in _SENTENCE.split(line):
                part = tokens(sentence)
                if self.filed.isdisjoint(part):
                    continue
                for at in range(0, len(part), WINDOW // 2):
                    window = part[at : at + WINDOW]
                    if got := self.best(window):
                        matched[got[0]] += min(len(window), WINDOW // 2 if at + WINDOW < len(part) else WINDOW)
                        by.setdefault(*got)
        for kind in ("placeholder", "filler"):
            if matched[kind]:
                return kind, by[kind]
        if matched and matched["error"] + matched["gate"] >= MOST * sum(len(tokens(line)) for line in lines):
            kind = max(("error", "gate"), key=lambda k: matched[k])
            return kind, by[kind]
        return None


def corpus_index(texts: DataFrame, text: str) -> Index:
    """The index, weighted by document frequencies over all of ``texts``."""
    index = Index()
    vocabulary = index.vocabulary

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for df in batches:
            seen[""] += len(df)
            for body in df.iloc[:, 0]:
                if body:
                    seen.update(vocabulary & words(body))
        yield pd.DataFrame({"t": list(seen), "n": list(seen.values())}, columns=["t", "n"])

    rows = texts.select(text).mapInPandas(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    df = {r["t"]: r["n"] for r in rows}
    return index.weigh(df, df.get("", 0))


def residue(texts: DataFrame, ident: str, text: str, among: DataFrame | None = None) -> DataFrame:
    """``ident``, ``kind`` and ``exemplar`` of every text that holds residue or is an error page or a notice.

    ``among``, if given, holds the texts to judge; document frequencies are those of all ``texts``.
    """
    index = texts.sparkSession.sparkContext.broadcast(corpus_index(texts, text))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [(i, *got) for i, b in zip(df["_id"], df["_text"]) if (got := index.value.judge(b))]
            yield pd.DataFrame(found, columns=["_id", "kind", "exemplar"])

    schema = f"_id {texts.schema[ident].dataType.simpleString()}, kind string, exemplar string"
    asked = texts if among is None else among
    return asked.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).mapInPandas(judge, schema).withColumnRenamed("_id", ident)

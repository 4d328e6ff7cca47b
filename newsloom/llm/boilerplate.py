"""The main body of a page: wrappers inferred per host by aligning token streams.

A page is a stream of lines. Lines that recur on the pages of a host, or on several hosts with the site's name masked, are
candidates for its literals; runs of menu entries and lines made of entries are repeated groups; all else is text.
The streams of one host are aligned one after the other (longest common subsequence) into a union-free wrapper: equal
tokens become one node, a token that one side lacks becomes an optional node, what lies between nodes is a text slot,
and a slot that holds a run of headlines after most occurrences of a node is a repeated group that the node heads.
Hosts are worked in groups of bounded size (a hot host is split by salt) and their partial wrappers are aligned again in
a tree.

A page is read by aligning it with its host's wrapper. Lines that meet a node of enough support are the site's, and so
are repeated groups: menus, and the headlines below a node that heads them. Lines in slots are the article's, also those
of a literal's words that stand where the wrapper has no such node. Markup of the article's own structure (headings,
lists, quotes, code) is never a token. Null and empty bodies have no lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import page_key
from ..session import Scratch, join_small, materialize

#: Pages of one group: bounds what a task holds of a host.
GROUP_PAGES = 2_000
#: Nodes from which those of small support are folded together, so that alignment stays cheap.
NODES = 400
#: Share of a host's pages on which a line must recur, by kind of line: plain, naming the site, a whole sentence.
SHARE = {"plain": 0.015, "site": 0.015, "sentence": 0.12}
LEAST = 4
#: Share from which a host's literal also counts for other hosts, if two hosts or more have it so.
SHARED = 0.08
#: Pages of a host from which a plain line is its literal, however large the host.
ENOUGH = 20
#: Hosts, and share of all pages, from which a plain line counts everywhere.
HOSTS, SPREAD = 3, 1 / 20_000
#: Share of a node's occurrences that a run of headlines must follow for it to head a repeated group.
HEADS = 0.5
#: Pages that must meet a node for it to be the site's, if no other host shows the line.
MET = 2
#: Characters of a menu entry; entries that make a run of lines, or a line, a menu.
ENTRY, RUN = 24, 2
SITE = "§"
#: Tokens of repeated groups: a run of menu entries, a line of entries. Digests are never so small.
MENU, LIST = 1, 2
#: What a line is, besides its digest: of the article's structure, a possible headline, a menu entry, a line of entries, a
#: path to the page, a part of the line before.
OWN, HEADLINE, ENTRY_, ENTRIES, PATH, PART = 1, 2, 4, 8, 16, 32
LINE = np.dtype([("no", "<i4"), ("x", "<i8"), ("f", "u1")])
KINDS = ("plain", "site", "sentence", "code", "part", "page")
_SEPARATORS = re.compile(r"\s*[|·•›»>/]\s*|\s{2,}|\s+-\s+")
_STRUCTURE = re.compile(r"^\s*(?:#{1,6}\s|[-*+]\s|>\s?|\|)")
_END = re.compile(r"[.!?。！？…:;；：][\"”»’）)]*$")
_INNER = re.compile(r"[.!]\s+[A-ZÀ-Þ„“«¿¡]|[。！]")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_CODE = re.compile(r"[{}=$\\]|<[^<>]*>|://|^[a-z_]+: ")
_WIDE_GAP = re.compile(r"(?<=\S)\s{2,}(?=\S)")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def mask(line: str, site: str | None) -> str:
    line = line.strip()
    if "  " in line or "\t" in line or "\u3000" in line or not line.isprintable():
        line = _WIDE_GAP.sub(" | ", line)
    line = " ".join(line.split())
    if site and site.casefold() in line.casefold():
        line = re.sub(re.escape(site), SITE, line, flags=re.I)
    return _NUMBER.sub("0", line)


def kind(masked: str) -> str:
    return "site" if SITE in masked else "sentence" if _END.search(masked) else "code" if _CODE.search(masked) else "plain"


def digest(masked: str) -> int:
    return xxhash.xxh64_intdigest(masked) - (1 << 63)


def lines(body: str) -> Iterator[tuple[int, str, bool]]:
    """(number, line, whether it has markup of its own) of the lines that aren't empty."""
    code = False
    for i, line in enumerate(body.split("\n"), 1):
        if not line.strip():
            continue
        if _FENCE.match(line):
            code = not code
            yield i, line, True
        else:
            yield i, line, code or bool(_STRUCTURE.match(line))


def headline(line: str) -> bool:
    """Whether a line could be a headline, perhaps as an entry of a list: one clause, without a full stop, of some length."""
    s = _ITEM.sub("", line).strip()
    return 8 <= len(s) <= 220 and not re.search(r"[.。!！;；:：]$", s) and not _INNER.search(s)


def entry(line: str) -> bool:
    """Whether a line could be one entry of a menu, or the heading of a list of teasers."""
    s = line.strip()
    return len(s) <= ENTRY and not _END.search(s) and not any(c.isdigit() for c in s)


def segments(masked: str) -> list[str]:
    return [s for s in _SEPARATORS.split(masked) if s]


class Wrapper:
    """A union-free wrapper: nodes [token, pages that meet it, pages on which a run of headlines follows]; between nodes lie slots."""

    def __init__(self, nodes: list | None = None, pages: int = 0) -> None:
        self.nodes = nodes or []
        self.pages = pages
        self._index()

    def _index(self) -> None:
        self.places: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(self.nodes):
            self.places[x[0]].append(i)

    def match(self, tokens: list[int]) -> list[int]:
        """The node of every token in the longest common subsequence, -1 for tokens outside it."""
        ends: list[int] = []  # the smallest node that a common subsequence of each length ends at
        last: list[tuple[int, int]] = []
        back: list[tuple[int, int, int]] = []
        for k, t in enumerate(tokens):
            for j in reversed(self.places.get(t, ())):
                at = bisect_left(ends, j)
                back.append((k, j, last[at - 1][1] if at else -1))
                if at == len(ends):
                    ends.append(j)
                    last.append((j, len(back) - 1))
                else:
                    ends[at] = j
                    last[at] = (j, len(back) - 1)
        out = [-1] * len(tokens)
        i = last[-1][1] if last else -1
        while i >= 0:
            k, j, i = back[i]
            out[k] = j
        return out

    def align(self, tokens: list[int], support: list[int], follow: list[int], pages: int) -> None:
        self.pages += pages
        found = self.match(tokens)
        if -1 not in found:
            for k, j in enumerate(found):
                self.nodes[j][1] += support[k]
                self.nodes[j][2] += follow[k]
            return
        out, at = [], 0
        for k, j in enumerate(found):
            if j < 0:  # an optional node, as the wrapper lacks it here
                out.append([tokens[k], support[k], follow[k]])
                continue
            out += self.nodes[at:j]
            x = self.nodes[j]
            out.append([x[0], x[1] + support[k], x[2] + follow[k]])
            at = j + 1
        self.nodes = out + self.nodes[at:]
        if len(self.nodes) > NODES:
            self.nodes = self._folded(self.nodes)
        self._index()

    @staticmethod
    def _folded(nodes: list) -> list:
        """The weaker half of the nodes folded into the strongest node of their token: no token and no support is lost."""
        best: dict[int, list] = {}
        for x in nodes:
            if x[0] not in best or x[1] > best[x[0]][1]:
                best[x[0]] = x
        weak = sorted(x[1] for x in nodes)[len(nodes) // 2]
        for x in nodes:
            b = best[x[0]]
            if x is not b and x[1] <= weak:
                b[1] += x[1]
                b[2] += x[2]
                x[1] = 0
        return [x for x in nodes if x[1]]

    def merge(self, other: Wrapper) -> None:
        self.align([x[0] for x in other.nodes], [x[1] for x in other.nodes], [x[2] for x in other.nodes], other.pages)

    def heading(self) -> set[int]:
        """Tokens whose nodes, taken together, head a repeated group."""
        total: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for t, n, f in self.nodes:
            total[t][0] += n
            total[t][1] += f
        return {t for t, (n, f) in total.items() if f >= HEADS * n}

    def dump(self) -> bytes:
        return np.array([[self.pages, 0, 0], *self.nodes], dtype=np.int64).tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Wrapper:
        rows = np.frombuffer(raw, dtype=np.int64).reshape(-1, 3).tolist()
        return cls([list(x) for x in rows[1:]], rows[0][0])


class Parser:
    """Reads lines into tokens, each distinct line once."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, str | None], tuple] = {}

    def line(self, line: str, site: str | None) -> tuple[int, int, int, tuple[int, ...], str]:
        """Digest, kind, flags, digests of the parts, and the first part of a line."""
        got = self.seen.get((line, site))
        if got is None:
            m = mask(line, site)
            end = bool(_END.search(m))
            parts = [m] if end and len(m) > 200 else segments(m)  # a paragraph is no menu
            flags = HEADLINE * headline(line) | ENTRY_ * entry(line)
            if len(parts) >= 3 and not end and all(len(p) <= ENTRY + 8 for p in parts):
                flags |= ENTRIES
            small = tuple(digest(p) for p in parts) if 2 <= len(parts) and (not end or all(len(p) <= ENTRY for p in parts)) else ()
            got = digest(m), KINDS.index(kind(m)), flags, small, parts[0] if len(parts) > 1 else ""
            if len(self.seen) > 50_000:
                self.seen.clear()
            if len(line) <= 300:
                self.seen[line, site] = got
        return got

    def page(self, body: str, site: str | None, title: str | None) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """The lines of a page (``LINE``; a line's parts follow it), and the distinct (digest, kind) of its lines and parts."""
        out, counted = [], set()
        title = " ".join((title or "").casefold().split())[:24]
        for no, line, own in lines(body):
            if own:  # an entry of a list may still belong to a repeated group
                out.append((no, 0, OWN | HEADLINE * bool(_ITEM.match(line) and headline(line))))
                continue
            x, k, f, parts, first = self.line(line, site)
            if title and first and len(first) <= ENTRY and " ".join(line.split()).casefold().find(title) > 0:
                f |= PATH
            out.append((no, x, f))
            counted.add((x, k))
            for p in parts:
                out.append((no, p, PART))
                counted.add((p, 4))
        return np.array(out, dtype=LINE), counted


def tokens_of(rows: np.ndarray, literal: set[int]) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """The stream of a page: tokens, the lines each stands for, and the run of headlines that follows it."""
    page: list[list] = []  # number, digest, flags, whether all parts are a menu's words, number of those
    for no, x, f in rows.tolist():
        if f == PART:
            page[-1][3] &= x in literal
            page[-1][4] += x in literal
        else:
            page.append([no, x, f, True, 0])
    tokens: list[int] = []
    of: list[list[int]] = []
    heads: list[list[int]] = []
    after = False  # whether headlines would follow the last token
    n = len(page)
    short = [bool(f & ENTRY_) and not f & OWN for _, _, f, _, _ in page]
    lit = [not f & OWN and x in literal for _, x, f, _, _ in page]
    for k, (no, x, f, menu, known) in enumerate(page):
        if f & OWN:
            if after and f & HEADLINE:
                heads[-1].append(no)
            else:
                after = False
            continue
        token = 0
        if lit[k]:
            token = x
        elif f & (ENTRIES | PATH) or known and menu or known >= 2 and not f & HEADLINE:
            token = LIST
        elif short[k]:
            near = k and (short[k - 1] or lit[k - 1]) or k + 1 < n and (short[k + 1] or lit[k + 1])
            heading = k + 1 < n and page[k + 1][2] & HEADLINE and not short[k + 1] and not lit[k + 1]
            token = MENU if near or heading else 0
        if token == MENU and tokens and tokens[-1] == MENU and of[-1][-1] == page[k - 1][0]:
            of[-1].append(no)  # a run is one group
            after = True
        elif token:
            tokens.append(token)
            of.append([no])
            heads.append([])
            after = True
        elif after and f & HEADLINE:
            heads[-1].append(no)
        else:
            after = False
    return tokens, of, heads


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages as packed lines, and per host how many pages hold a line: two kinds of rows, as the text is read once."""
    parser = Parser()
    seen: Counter = Counter()

    def counts() -> pd.DataFrame:
        return pd.DataFrame([(h, None, None, x, k, n) for (h, x, k), n in seen.items()], columns=["_host", "_id", "lines", "x", "kind", "n"])

    for df in batches:
        out = []
        for ident, host, site, body, title in zip(df["_id"], df["_host"], df["_site"], df["_text"], df["_title"]):
            rows, counted = parser.page(body, site, title)
            out.append((host, ident, rows.tobytes(), 0, 5, 1))
            seen[host, 0, 5] += 1
            for x, k in counted:
                seen[host, x, k] += 1
        yield pd.DataFrame(out, columns=["_host", "_id", "lines", "x", "kind", "n"])
        if len(seen) > 200_000:
            yield counts()
            seen = Counter()
    if seen:
        yield counts()


def literals(counts: DataFrame) -> DataFrame:
    """Candidates for literals per host: ``_host``, ``x``, and whether other hosts show the line too (``shared``).

    ``counts`` has the pages per _host, x and kind (of ``KINDS``).
    """
    totals = counts.where(F.col("kind") == KINDS.index("page")).select("_host", F.col("n").alias("pages"))
    every = totals.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    site, sentence, plain, part = (F.col("kind") == KINDS.index(k) for k in ("site", "sentence", "plain", "part"))
    lines_ = counts.where(F.col("kind") != KINDS.index("page"))
    told = join_small(lines_, totals, ["_host"], "inner").withColumn("share", F.col("n") / F.col("pages"))
    least = F.when(site, SHARE["site"]).when(sentence, SHARE["sentence"]).otherwise(SHARE["plain"])
    own = told.where((F.col("n") >= LEAST) & ((F.col("share") >= least) | ((plain | part) & (F.col("n") >= ENOUGH))))
    wide = own.where((F.col("share") >= SHARED) | site).groupBy("x").agg(F.count_distinct("_host").alias("hosts")).where("hosts >= 2")
    # lines that recur over hosts; plain ones by a share of all pages as well, so that chance doesn't do it on large tables
    most = F.when(F.first("kind") == KINDS.index("site"), LEAST).otherwise(max(LEAST, every * SPREAD))
    over = lines_.where(site | plain | part).groupBy("x").agg(F.count_distinct("_host").alias("hosts"), F.sum("n").alias("n"), most.alias("most"))
    shared = wide.select("x").unionByName(over.where((F.col("hosts") >= HOSTS) & (F.col("n") >= F.col("most"))).select("x")).distinct()
    here = lines_.select("_host", "x").join(shared.withColumn("shared", F.lit(True)), "x")  # only lines that the host has
    return own.select("_host", "x", F.lit(False).alias("shared")).unionByName(here.select("_host", "x", "shared")).groupBy("_host", "x").agg(F.max("shared").alias("shared"))


def main_body(articles: DataFrame, ident: str, text: str, host: str, site: str, title: str) -> DataFrame:
    """The site's lines of every page: ``ident``, ``line_no`` (from 1). ``host`` groups pages, ``site`` is the name to mask."""
    with Scratch(articles.sparkSession, "pages") as scratch:
        return materialize(_main_body(articles, ident, text, host, site, title, scratch), "site-lines")


def _main_body(articles: DataFrame, ident: str, text: str, host: str, site: str, title: str, scratch: Scratch) -> DataFrame:
    id_type = articles.schema[ident].dataType.simpleString()
    pages = articles.where(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.xxhash64(F.coalesce(F.col(host), F.lit(""))).alias("_host"), F.col(ident).alias("_id"), F.col(site).alias("_site"), F.col(text).alias("_text"), F.col(title).alias("_title")
    )
    parsed = scratch.write(pages.mapInPandas(_parsed, f"_host long, _id {id_type}, lines binary, x long, kind int, n long"))
    counts = parsed.where("lines is null").groupBy("_host", "x", "kind").agg(F.sum("n").alias("n"))
    known = scratch.write(literals(scratch.write(counts)))
    pages = parsed.where("lines is not null").select("_host", "_id", "lines")
    sizes = scratch.write(pages.groupBy("_host").count().select("_host", F.ceil(F.col("count") / GROUP_PAGES).cast("int").alias("_salts")))
    keyed = join_small(pages, sizes, ["_host"], "inner").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int"))
    by = ["_host", "_salt"]
    keyed = scratch.write(keyed.select(*by, "_id", "lines"))
    mine = known.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("x", "shared"))).alias("_lit"))
    salted = lambda df: sizes.join(df, "_host", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")

    def infer(key: tuple, mine: pd.DataFrame, lits: pd.DataFrame) -> pd.DataFrame:
        literal = {int(r["x"]) for row in lits["_lit"] if row is not None for r in row}
        streams: Counter = Counter()
        for raw in mine["lines"]:
            tokens, _, heads = tokens_of(np.frombuffer(raw, dtype=LINE), literal)
            streams[tuple(tokens), tuple(bool(h) for h in heads)] += 1
        wrapper = Wrapper()
        for (tokens, follow), n in sorted(streams.items(), key=lambda x: (-x[1], x[0])):
            wrapper.align(list(tokens), [n] * len(tokens), [n * f for f in follow], n)
        return pd.DataFrame({"_host": [key[0]], "part": [int(key[1])], "wrapper": [wrapper.dump()]})

    schema = "_host long, part int, wrapper binary"
    parts = scratch.write(keyed.groupBy(*by).cogroup(salted(mine).groupBy(*by)).applyInPandas(infer, schema))

    def join(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("part")
        whole = Wrapper.load(df["wrapper"].iloc[0])
        for w in df["wrapper"].iloc[1:]:
            whole.merge(Wrapper.load(w))
        return pd.DataFrame({"_host": [key[0]], "part": [int(key[1])], "wrapper": [whole.dump()]})

    most = sizes.agg(F.max("_salts")).first()[0] or 1
    while most > 1:
        parts = scratch.write(parts.groupBy("_host", F.floor(F.col("part") / 32).cast("int").alias("_to")).applyInPandas(join, schema))
        most = -(-most // 32)

    def read(key: tuple, mine: pd.DataFrame, wrap: pd.DataFrame) -> pd.DataFrame:
        lits = [r for row in wrap["_lit"] if row is not None for r in row]
        literal, shared = {int(r["x"]) for r in lits}, {int(r["x"]) for r in lits if r["shared"]}
        wrapper = Wrapper.load(wrap["wrapper"].iloc[0]) if len(wrap) else Wrapper()
        heading = wrapper.heading()
        ids, nos = [], []
        for ident_, raw in zip(mine["_id"], mine["lines"]):
            tokens, of, heads = tokens_of(np.frombuffer(raw, dtype=LINE), literal)
            for t, j, mine_, below in zip(tokens, wrapper.match(tokens), of, heads):
                if j < 0:
                    continue
                _, support, follow = wrapper.nodes[j]
                if support < MET and t not in shared and t not in (MENU, LIST):
                    continue
                got = mine_ + below if below and (follow >= HEADS * support or t in heading) else mine_
                ids += [ident_] * len(got)
                nos += got
        return pd.DataFrame({"_id": ids, "line_no": nos})

    wrapped = salted(parts.select("_host", "wrapper").join(mine, "_host", "left"))
    found = keyed.groupBy(*by).cogroup(wrapped.groupBy(*by)).applyInPandas(read, f"_id {id_type}, line_no int")
    return found.withColumnRenamed("_id", ident)


def host_of(url: str | None) -> str | None:
    key = page_key(url)
    return re.split(r"[/?]", key, maxsplit=1)[0] if key else None


def with_host(articles: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """``articles`` with ``host`` (of the address, else of the source's domain) and ``site`` (the catalogue's name of that host)."""
    from ..functions.names import fold_host

    # a named function keeps the annotation that decides the kind of the UDF
    def hosts(urls: pd.Series) -> pd.Series:
        return urls.map(host_of, na_action="ignore")

    host = F.pandas_udf(hosts, "string")(F.col(url))
    names = sources.select(fold_host(F.col("sourceDomain")).alias("host"), F.col("source").alias("site")).where(F.col("host").isNotNull()).groupBy("host").agg(F.min("site").alias("site"))
    out = articles.withColumn("host", F.coalesce(host, fold_host(F.col("sourceDomain"))))
    return join_small(out, names, ["host"])

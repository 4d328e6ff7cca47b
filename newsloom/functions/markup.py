"""Pages as text blocks and media references, for Arrow batches of landed pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "noscript", "nav", "footer", "aside", "form", "svg", "template", "head"}
_BREAK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "figure", "header", "br"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[str] = []
        self.images: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.prefix = ""
        self.skip = self.pre = 0
        self.stack: list[str] = []

    def close_block(self) -> None:
        raw = "".join(self.text)
        text = raw.strip("\n") if self.pre else " ".join(raw.split())
        self.text = []
        if text.strip():
            self.blocks.append(f"```\n{text}\n```" if self.pre else self.prefix + text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _VOID:
            self.stack.append(tag)
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        a = dict(attrs)
        if tag == "img" and (src := a.get("src") or largest(a.get("srcset"))):
            self.images.append((src, a.get("alt") or ""))
        if re.fullmatch(r"h[1-6]|li|blockquote|pre", tag) or tag in _BREAK and not self.pre:
            self.close_block()
            self.prefix = "#" * int(tag[1]) + " " if re.fullmatch(r"h[1-6]", tag) else "- " if tag == "li" else "> " if tag == "blockquote" else self.prefix if tag in _BREAK and self.prefix in ("- ", "> ") else ""
            self.pre += tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if top in _SKIP:
                self.skip -= 1
            elif not self.skip and (re.fullmatch(r"h[1-6]|li|blockquote|pre", top) or top in _BREAK and not self.pre):
                self.close_block()
                self.pre -= top == "pre"
                if top not in _BREAK:
                    self.prefix = ""
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def largest(srcset: str | None) -> str | None:
    """The widest candidate of a ``srcset``."""
    best = (-1.0, None)
    for part in re.split(r",\s+", srcset or ""):
        bits = part.split()
        if bits:
            m = re.fullmatch(r"([\d.]+)[wx]", bits[1]) if len(bits) > 1 else None
            best = max(best, (float(m.group(1)) if m else 0.0, bits[0]), key=lambda x: x[0])
    return best[1]


def page_blocks(page: str | None) -> tuple[str, list[tuple[str, str]]]:
    """The text of a page (headings ``#``, lists ``-``, quotes ``>``, code fenced) and its images (src, alt), each once."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close_block()
    return "\n\n".join(reader.blocks), list(dict.fromkeys(reader.images))


def read_pages(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """``ident``, ``body``, ``images`` (array of src, alt) of landed pages; null pages give empty bodies."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            got = [page_blocks(h) for h in df["_html"]]
            yield pd.DataFrame({"_id": df["_id"], "body": [b for b, _ in got], "images": [[{"src": s, "alt": a} for s, a in i] for _, i in got]})

    kind = pages.schema[ident].dataType.simpleString()
    out = pages.select(F.col(ident).alias("_id"), F.col(html).alias("_html")).mapInPandas(read, f"_id {kind}, body string, images array<struct<src:string,alt:string>>")
    return out.withColumnRenamed("_id", ident)

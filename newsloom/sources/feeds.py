"""Landed feeds, card pages and sitemaps as tables.

Payloads are read as binary files or a column and parsed in Arrow batches; each scan returns one row per entry. Bad
payloads give no rows. Network access is no part of it: files are landed by whoever fetches them.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "source string, title string, url string, summary string, published timestamp"
SUMMARY_CHARS = 420
_FORMATS = ("%B %d, %Y", "%b %d, %Y")


def parse_date(value: str | None) -> datetime | None:
    """RFC 2822, ISO 8601 or ``October 5, 2026``; None for anything else."""
    if not value or not value.strip():
        return None
    value = value.strip()
    readers = [parsedate_to_datetime, lambda v: datetime.fromisoformat(v.replace("Z", "+00:00")), *[lambda v, f=f: datetime.strptime(v, f) for f in _FORMATS]]
    for read in readers:
        try:
            out = read(value)
        except (TypeError, ValueError):
            continue
        return (out if out.tzinfo else out.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    return None


def plain(markup: str | None) -> str:
    """Text without tags and entities, blanks collapsed."""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", html.unescape(markup or ""))).split())


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def feed_entries(payload: bytes | str) -> Iterator[dict]:
    """Entries of an RSS or Atom payload, whatever its namespaces; entries without title or link are left out."""
    try:
        root = ET.fromstring(payload)
    except (ET.ParseError, ValueError):
        return
    for node in root.iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        parts: dict[str, list[ET.Element]] = {}
        for child in node:
            parts.setdefault(_local(child.tag), []).append(child)
        first = lambda *names: next((("".join(e.itertext())).strip() for n in names for e in parts.get(n, []) if "".join(e.itertext()).strip()), "")
        links = parts.get("link", [])
        url = next((e.get("href") for e in links if e.get("href") and e.get("rel", "alternate") == "alternate"), None) or next((e.text.strip() for e in links if e.text and e.text.strip()), None)
        rich = max((plain("".join(e.itertext())) for n in ("description", "summary", "content", "encoded") for e in parts.get(n, [])), key=len, default="")
        title = plain(first("title"))
        if title and url:
            yield {"title": title, "url": url, "summary": rich[:SUMMARY_CHARS], "published": parse_date(first("pubdate", "published", "updated", "date"))}


class _Cards(HTMLParser):
    """Cards are ``div[role=listitem]``: the first heading or link text is the title, a ``time`` or dated text the date."""

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.card, self.cards, self.stack = 0, None, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if self.card is None and tag == "div" and a.get("role") == "listitem":
            self.card, self.depth = {"url": None, "title": "", "date": ""}, 0
        if self.card is not None:
            self.depth += tag == "div"
            self.stack.append(tag)
            if tag == "a" and a.get("href") and not self.card["url"]:
                self.card["url"] = a["href"]
            if tag == "time" and a.get("datetime"):
                self.card["date"] = a["datetime"]

    def handle_endtag(self, tag: str) -> None:
        if self.card is None:
            return
        while self.stack and self.stack.pop() != tag:
            pass
        if tag == "div":
            self.depth -= 1
            if self.depth == 0:
                self.cards.append(self.card)
                self.card = None

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if self.card is None or not text:
            return
        if not self.card["date"] and parse_date(text):
            self.card["date"] = text
        elif not self.card["title"]:
            self.card["title"] = text


def card_entries(page: str, base: str = "") -> Iterator[dict]:
    """Cards of a listing page; the first card of an address wins."""
    from urllib.parse import urljoin

    reader, seen = _Cards(), set()
    reader.feed(page or "")
    for card in reader.cards:
        url = urljoin(base, card["url"] or "")
        if card["url"] and card["title"] and url not in seen:
            seen.add(url)
            yield {"title": card["title"], "url": url, "summary": "", "published": parse_date(card["date"])}


def sitemap_entries(payload: bytes | str, allow: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> Iterator[dict]:
    """Addresses of a sitemap whose path starts with one of ``allow`` (all, if none is given); titles from the slug."""
    try:
        root = ET.fromstring(payload)
    except (ET.ParseError, ValueError):
        return
    for node in root.iter():
        if _local(node.tag) != "url":
            continue
        got = {_local(c.tag): (c.text or "").strip() for c in node}
        url = got.get("loc", "")
        path = re.sub(r"^https?://[^/]+", "", url)
        if not re.match(r"https?://", url) or url in skip or allow and not path.startswith(allow):
            continue
        slug = path.rstrip("/").rsplit("/", 1)[-1]
        if slug:
            yield {"title": re.sub(r"[-_]+", " ", slug).strip().capitalize(), "url": url, "summary": "", "published": parse_date(got.get("lastmod"))}


def page_metadata(page: str | None) -> dict:
    """Title, description and date of a page's head, from its meta tags, else its title and scripts."""
    page = page or ""
    meta = {}
    for tag in re.findall(r"<meta\b[^>]*>", page, re.I):
        a = dict((k.lower(), html.unescape(v)) for k, _, v in re.findall(r"([\w:-]+)\s*=\s*(\"|')(.*?)\2", tag))
        if (key := a.get("property") or a.get("name")) and "content" in a:
            meta.setdefault(key.lower(), a["content"])
    title = meta.get("og:title") or plain(next(iter(re.findall(r"<title[^>]*>(.*?)</title>", page, re.I | re.S)), ""))
    date = meta.get("article:published_time") or meta.get("datepublished") or next(iter(re.findall(r"\"datePublished\"\s*:\s*\"([^\"]+)\"", page)), None)
    return {"title": re.sub(r"\s+[|–—-]\s+[^|–—-]{2,40}$", "", title), "summary": meta.get("og:description") or meta.get("description") or "", "published": parse_date(date)}


def scan(landed: DataFrame, payload: str = "payload", source: str = "source", form: str = "form") -> DataFrame:
    """Entries of landed payloads (source, form of feed / html-cards / sitemap, payload as text), one row each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"feed": feed_entries, "html-cards": card_entries, "sitemap": sitemap_entries}
        for df in batches:
            rows = [{"source": s} | e for s, f, p in zip(df["_s"], df["_f"], df["_p"]) if p and f in readers for e in readers[f](p)]
            out = pd.DataFrame(rows, columns=["source", "title", "url", "summary", "published"])
            out["published"] = pd.to_datetime(out["published"], utc=True)
            yield out

    return landed.select(F.col(source).alias("_s"), F.col(form).alias("_f"), F.col(payload).cast("string").alias("_p")).mapInPandas(read, ENTRY)


def json_lines(spark, path: str, schema: str, required: str) -> DataFrame:  # noqa: ANN001
    """Line-delimited JSON without blank or broken lines and rows that lack ``required``."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(required).isNotNull())

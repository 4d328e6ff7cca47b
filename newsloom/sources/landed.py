"""Landed payloads and files as tables: images of feed entries, forum posts, aggregator tokens, snapshots, file sizes, answers of models."""

from __future__ import annotations

import base64
import binascii
import html
import json
import re
import xml.etree.ElementTree as ET
from urllib.parse import parse_qs, urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import largest

MOST_IMAGES = 12
_IMAGE = re.compile(r"\.(?:avif|gif|jpe?g|png|webp)$", re.I)
_TAG = re.compile(r"<img\b[^>]*>", re.I)
_ATTR = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def entry_images(entry: str | bytes, base: str = "") -> list[str]:
    """Addresses of the pictures of one feed entry: in its text, then in its media elements; each once, twelve at most."""
    try:
        root = ET.fromstring(entry)
    except (ET.ParseError, ValueError, TypeError):
        return []
    found: list[str] = []
    for node in root.iter():
        name, kind = node.tag.rsplit("}", 1)[-1].lower(), node.get("type", "").lower()
        text = "".join(node.itertext())
        if name in ("description", "summary", "content", "encoded"):
            for tag in _TAG.findall(html.unescape(text)):
                a = {k.lower(): v or w for k, v, w in _ATTR.findall(tag)}
                found.append(a.get("src") or largest(a.get("srcset")) or "")
        if name in ("enclosure", "content", "thumbnail", "image"):
            for value in (node.get("url"), node.get("href"), node.get("src"), (node.text or "").strip()):
                is_image = kind.startswith("image/")
                named = bool(_IMAGE.search(urlsplit(value or "").path))
                if value and (is_image or not kind and name != "enclosure" and (name == "thumbnail" or named)):
                    found.append(value)
    full = [urljoin(base, html.unescape(v).strip()) for v in found if v]
    return list(dict.fromkeys(u for u in full if urlsplit(u).scheme in ("http", "https")))[:MOST_IMAGES]


def forum_posts(payloads: DataFrame, column: str, least: int = 280) -> DataFrame:
    """The body of the first post of a landed answer of either shape (a list of listings, or a stream of posts); bodies that
    are too short, and answers of neither shape, are null."""
    listing = F.from_json(column, "array<struct<data:struct<children:array<struct<data:struct<selftext:string>>>>>>")
    stream = F.from_json(column, "post_stream struct<posts:array<struct<cooked:string>>>")
    cooked = F.trim(F.regexp_replace(F.regexp_replace(stream["post_stream"]["posts"][0]["cooked"], "<[^>]*>", " "), r"\s+", " "))
    body = F.coalesce(F.trim(F.get(F.get(listing, F.lit(0))["data"]["children"], F.lit(0))["data"]["selftext"]), cooked)
    return payloads.withColumn("body", F.when(F.length(body) >= least, body))


def token_address(token: str | None) -> str | None:
    """The address that an aggregator's offline token holds: a length as a variable integer, then that many bytes."""
    try:
        raw = base64.urlsafe_b64decode((token or "") + "=" * (-len(token or "") % 4))
    except (binascii.Error, ValueError):
        return None
    raw = raw.removeprefix(b"\x08\x13\x22").removesuffix(b"\xd2\x01\x00")
    if not raw:
        return None
    size, at = raw[0] & 127, 1
    if raw[0] & 128 and len(raw) > 1:
        size, at = size | raw[1] << 7, 2
    elif raw[0] & 128:
        at = 2
    out = raw[at : at + size].decode("utf-8", "ignore")
    return out if out.startswith(("http://", "https://")) else None


def redirect_target(url: str | None) -> str | None:
    """Where an aggregator's address leads without asking it: its ``url`` parameter, else its last part as a token."""
    parts = urlsplit(url or "")
    named = parse_qs(parts.query).get("url") or parse_qs(parts.query).get("q")
    if named and named[0].startswith(("http://", "https://")):
        return named[0]
    return token_address(parts.path.rstrip("/").rsplit("/", 1)[-1]) if parts.path else None


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records below ``path``, however deep; records that can't be read are left out and don't stop the scan."""
    full = f"{schema}, _bad string"
    rows = spark.read.schema(full).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of all files below ``path``; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


_ID = re.compile(r"b\d{4}")


def answer_blocks(content: str | None, asked: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Translated blocks of a model's answer, and why others failed: each block stands for itself.

    The answer is JSON, perhaps in a fence or within prose: a list of entries, a map by id, or ids at the top.
    """
    text = re.sub(r"^```(?:json)?\s*|\s*```$", "", (content or "").strip(), flags=re.I)
    try:
        whole = json.loads(text)
    except ValueError:
        try:
            whole = json.loads(text[text.index("{") : text.rindex("}") + 1])
        except ValueError:
            return {}, dict.fromkeys(asked, "no JSON object")
    if not isinstance(whole, dict):
        return {}, dict.fromkeys(asked, "no JSON object")
    raw = next((whole[k] for k in ("translations", "results", "items", "data", "translatedBlocks") if whole.get(k) is not None), None)
    if raw is None:
        raw = {k: v for k, v in whole.items() if _ID.fullmatch(k)}
    if isinstance(raw, dict):
        raw = [{"id": k} | (v if isinstance(v, dict) else {"translationZh": v}) for k, v in raw.items()]
    by_id: dict[str, list[str]] = {}
    for e in raw if isinstance(raw, list) else ():
        if isinstance(e, dict):
            said = e.get("translationZh") or e.get("translation") or e.get("zh") or ""
            by_id.setdefault(str(e.get("id", "")), []).append(re.sub(r"^```(?:\w+)?\s*|\s*```$", "", " ".join(str(said).split())).strip())
    good, bad = {}, {}
    for ident in asked:
        mine = by_id.get(ident, [])
        if len(mine) != 1:
            bad[ident] = "missing or duplicate block id"
        elif not re.search("[一-鿿]", mine[0]):
            bad[ident] = "not Chinese"
        else:
            good[ident] = mine[0]
    return good, bad


def media_path(name: Column) -> Column:
    """Where a stored picture lies, by the hash of its address."""
    return F.concat(F.lit("media/"), F.substring(F.sha2(name, 256), 1, 2), F.lit("/"), F.substring(F.sha2(name, 256), 1, 16))


def post_images(payload: str | None, hosts: dict[str, int], most: int = MOST_IMAGES) -> list[str]:
    """Pictures of a forum post: what it links to, its previews, its gallery; each once, at most ``most``.

    ``hosts`` names the hosts that serve one upload under one file name, and their rank: of its variants the one of least
    rank stays, plain addresses before sized ones, in the place of the first.
    """
    try:
        post = json.loads(payload or "")
    except ValueError:
        return []
    if not isinstance(post, dict):
        return []
    part = lambda x, *keys: part(x.get(keys[0]), *keys[1:]) if keys and isinstance(x, dict) else (None if keys else x)
    linked = str(post.get("url_overridden_by_dest") or "")
    found = [linked] if _IMAGE.search(linked.split("?", 1)[0]) else []
    previews = part(post, "preview", "images")
    found += [part(i, "source", "url") for i in previews if isinstance(i, dict)] if isinstance(previews, list) else []
    gallery = post.get("media_metadata")
    found += [part(v, "s", "u") for v in gallery.values()] if isinstance(gallery, dict) else []
    urls = [u for v in found if (u := html.unescape(str(v or "")).strip()).startswith(("http://", "https://"))]
    kept: dict[str, str] = {}

    def rank(url: str) -> int:
        return hosts[(urlsplit(url).hostname or "").lower()] + bool(urlsplit(url).query)

    for url in dict.fromkeys(urls):
        parts = urlsplit(url)
        name = parts.path.rsplit("/", 1)[-1].lower()
        key = name if name and (parts.hostname or "").lower() in hosts else url
        if key not in kept or key is name and rank(url) < rank(kept[key]):
            kept[key] = url
    return list(kept.values())[:most]

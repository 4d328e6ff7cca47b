"""One spelling per page address."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query keys that only track a visit
TRACKING_KEYS = frozenset("fbclid gclid dclid msclkid yclid mc_cid mc_eid igshid spm ref ref_src ref_url cmpid".split())
#: Keys that the canonical spelling of an address drops, besides those that begin with ``utm_``.
CANONICAL_DROPPED = frozenset("fbclid gclid mc_cid mc_eid ref_src s_cid".split())
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_")
# fixed values: host labels that only name a rendition of the site
RENDITIONS = ("www.", "m.", "amp.", "mobile.")
_REDIRECT_KEYS = ("u", "url", "q", "target", "to", "dest")
_SIMPLE = re.compile(r"https?://([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*)((?:/[A-Za-z0-9._~-]+)*)/?(?:\?((?:[A-Za-z0-9_-]+=[A-Za-z0-9._-]*)(?:&[A-Za-z0-9_-]+=[A-Za-z0-9._-]*)*))?")


def _simple_key(text: str) -> str | None:
    """The key of an address in plain characters that needs none of the rules; None for any other."""
    m = _SIMPLE.fullmatch(text)
    if not m or m[1].startswith(RENDITIONS):
        return None
    if not m[3]:
        return m[1] + m[2]
    pairs = sorted(tuple(x.split("=", 1)) for x in m[3].split("&"))
    for k, _ in pairs:
        low = k.lower()
        if low in TRACKING_KEYS or low in _REDIRECT_KEYS or low.startswith(TRACKING_PREFIXES):
            return None
    return f"{m[1]}{m[2]}?" + "&".join(f"{k}={v}" for k, v in pairs)


def page_key(url: str | None, depth: int = 3) -> str | None:
    """The page an address points at, or None where there is none.

    Scheme, case of the host, renditions (``www.``, ``m.``), port, doubled and trailing slashes, the order of the query,
    tracking keys and the fragment don't count. A redirect address that carries an absolute one counts as that.
    """
    if not url or not url.strip():
        return None
    text = url.strip()
    if (simple := _simple_key(text)) is not None:
        return simple
    try:
        parts = urlsplit(text if "//" in text[:12] else f"//{text}")
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return text.lower()
    if not host:
        return text.lower()
    query = parse_qsl(parts.query, keep_blank_values=True)
    if depth:
        for key, value in query:
            if key.lower() in _REDIRECT_KEYS and re.match(r"https?:/{1,2}[^/\s]+\.[^/\s]+", value, re.I):
                return page_key(value, depth - 1)
    for label in RENDITIONS:
        if host.startswith(label) and host.count(".") > 1:
            host = host[len(label) :]
            break
    path = quote(unquote(re.sub(r"/{2,}", "/", parts.path)).rstrip("/"), safe="/:@!$&'()*+,;=~-._")
    kept = sorted((k, v) for k, v in query if not (k.lower() in TRACKING_KEYS or k.lower().startswith(TRACKING_PREFIXES)))
    return host + path + (f"?{urlencode(kept)}" if kept else "")


def canonical_url(url: str | None) -> str | None:
    """One spelling of an address that still leads there: unlike ``page_key`` it keeps scheme, host label and redirects.

    Default ports, doubled and trailing slashes, tracking keys, the order of the query and the fragment don't count. None
    for anything that is no address of the web.
    """
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or not host:
        return None
    if port and port != {"http": 80, "https": 443}[scheme]:
        host = f"{host}:{port}"
    path = re.sub("/{2,}", "/", parts.path or "/")
    kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in CANONICAL_DROPPED))
    return f"{scheme}://{host}{path.rstrip('/') or '/'}" + (f"?{urlencode(kept)}" if kept else "")


def _each(f: Callable[[str], str | None], url: Column) -> Column:
    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(f, na_action="ignore")

    # a stated type of the function decides the kind of the UDF
    keys.__annotations__ = {"urls": pd.Series, "return": pd.Series}
    return F.pandas_udf(keys, "string")(url)


def canonical_urls(url: Column) -> Column:
    """``canonical_url`` as a column, in Arrow batches."""
    return _each(canonical_url, url)


def page_keys(url: Column) -> Column:
    """``page_key`` as a column, in Arrow batches."""
    return _each(page_key, url)

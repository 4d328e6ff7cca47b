"""Source names and hosts in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "


def fold_name(name: Column) -> Column:
    """A source name without width, case, blank and feed-suffix variants; null where nothing is left."""
    plain = F.lower(F.translate(name, _WIDE, _ASCII))
    plain = F.regexp_replace(plain, r"[\s\p{Z}\p{Cf}]+", " ")
    plain = F.regexp_replace(plain, r"[ ]*[\(\[]?\b(?:rss|atom|feed)\b[\)\]]?[ ]*$", "")
    plain = F.trim(plain)
    return F.when(plain != "", plain)


def fold_host(host: Column) -> Column:
    """A host without scheme, path, port, leading ``www.``/``m.``/``amp.`` and trailing dot; null where nothing is left."""
    plain = F.lower(F.trim(F.translate(host, _WIDE, _ASCII)))
    plain = F.regexp_replace(plain, r"^[a-z]+://", "")
    plain = F.regexp_replace(plain, r"[/:?#].*$", "")
    plain = F.regexp_replace(plain, r"^(?:www\d?|m|amp|mobile)\.", "")
    plain = F.regexp_replace(plain, r"\.+$", "")
    return F.when(plain != "", plain)

"""Blocks of a stored text: kinds of lines as columns, numbered prose blocks as a table function over Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repair import block_fences

_FORMS = [("heading", re.compile(r"^#{1,6}\s+(.+)$")), ("list-item", re.compile(r"^(?:[-*+]|\d+[.)])\s+(.+)$")), ("blockquote", re.compile(r"^>\s?(.+)$"))]

_ESCAPED = re.compile(r"^\\(?=[#*+>\-]|\d+[.)]\s)")


def line_blocks(df: DataFrame, ident: str, text: str) -> DataFrame:
    """The kind of every line that isn't empty: ident, line_no (from 1), kind."""
    lines = df.select(ident, F.posexplode(F.split(text, "\n")).alias("p", "l")).withColumn("t", F.trim("l")).where("t <> ''")
    t = F.col("t")
    kind = F.when(t.rlike("^#{1,6} "), "heading").when(t.rlike(r"^([-*+]|\d+[.)]) "), "list-item").when(t.rlike("^>"), "blockquote").when(t.rlike("^```"), "fence").otherwise("text")
    return lines.select(ident, (F.col("p") + 1).alias("line_no"), kind.alias("kind"))


def blocks(body: str | None) -> list[tuple[str, str, str]]:
    """(id, kind, source) of a text's prose blocks: lines of a paragraph join, code is left out, ids count from b0001.

    Fences within lines and fences left open are put right first; a backslash before a mark of structure isn't text.
    """
    out: list[tuple[str, str]] = []
    open_lines: list[str] = []
    code = False

    def close() -> None:
        if open_lines:
            out.append(("paragraph", " ".join(open_lines)))
            open_lines.clear()

    for line in map(str.strip, block_fences(body or "").splitlines()):
        if line.startswith("```"):
            close()
            code = not code
        elif not code:
            form = next(((k, m.group(1)) for k, p in _FORMS if (m := p.match(line))), None)
            if form or not line:
                close()
            if form:
                out.append(form)
            elif line:
                open_lines.append(line)
    close()
    texts = [(k, " ".join(_ESCAPED.sub("", s).split())) for k, s in out]
    return [(f"b{n:04d}", k, s) for n, (k, s) in enumerate(((k, s) for k, s in texts if s), 1)]


def blocks_udtf_rows(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per block: ident, pos, block_id, kind, source, source_hash (first 16 digits of SHA-256)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(i, n, b, k, s, hashlib.sha256(s.encode()).hexdigest()[:16]) for i, body in zip(part["_id"], part["_text"]) for n, (b, k, s) in enumerate(blocks(body))]
            yield pd.DataFrame(rows, columns=["_id", "pos", "block_id", "kind", "source", "source_hash"])

    kind = df.schema[ident].dataType.simpleString()
    out = df.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).mapInPandas(cut, f"_id {kind}, pos int, block_id string, kind string, source string, source_hash string")
    return out.withColumnRenamed("_id", ident)

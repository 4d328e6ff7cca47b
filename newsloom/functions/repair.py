"""Repair of stored bodies: code fences, markup of papers, code that lost its line breaks.

Bodies are read in Arrow batches; code between fences is never treated as prose. Null stays null, empty stays empty.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
# fixed values: commands whose argument is text, and symbols
TEXT_COMMANDS = "textbf textit texttt textrm textsf textsc textup textsl emph textsuperscript textsubscript mathrm mathbf mathit mathsf mathtt operatorname underline overline text url cite ref".split()
SYMBOLS = dict(zip("alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega times cdot pm leq geq neq infty".split(), "αβγδεθλμπσφω×·±≤≥≠∞"))
_NESTED = [(re.compile(r"\\(?:" + "|".join(sorted(TEXT_COMMANDS, key=len, reverse=True)) + r")\s*\{([^{}]*)\}"), r"\1"), (re.compile(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}"), r"(\1)/(\2)"), (re.compile(r"\\sqrt\s*\{([^{}]*)\}"), r"sqrt(\1)")]
_FLAT = [
    (re.compile(r"\\(" + "|".join(SYMBOLS) + r")\b"), lambda m: SYMBOLS[m[1]]),
    (re.compile(r"\\href\s*\{[^{}]*\}\s*\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:left|right)\s*"), ""),
    (re.compile(r"\\(?:quad|qquad|enspace|hspace\s*\{[^{}]*\}|[,;:!])"), " "),
    (re.compile(r"\\([%&_#$])"), r"\1"),
    (re.compile(r"\${1,2}"), ""),
    (re.compile(r"(?<!\\)[\^_]\s*\{([^{}]*)\}"), r"\1"),
    (re.compile(r"(?<!\\)\^\s*([A-Za-z0-9+\-=()])"), r"\1"),
    (re.compile(r"\\(?:begin|end)\s*\{[^{}]*\}|\\[A-Za-z]+|(?<!\\)[{}]"), ""),
    (re.compile(r"[ \t]+"), " "),
]
_YAML = re.compile(r"(?<![\w-])[A-Za-z_][\w.-]*:(?=\s|$)")
_SHELL = re.compile(r"hf\s+download|(?:cd|curl|wget|docker|git|kubectl|npm|pip|pnpm|python\d*)\s+", re.I)
_PROGRAM = re.compile(r"\b(?:def|class|import|from|const|let|var|function)\b")
#: A quoted string, closed or not, or a separator of statements outside of one.
_STATEMENT = re.compile(r"""(["'`])(?:\\.|(?!\1)[^\\])*(?:\1|$)|;""", re.S)
_STARTS = re.compile(r"\s+(?=(?:from|import|(?:async\s+)?def|class|const|let|var)\s+\w|(?:if|for|while|try|with|return|assert)\b|[A-Za-z_]\w*(?:\[[^]]+\])?\s*=|[A-Za-z_]\w*\.(?:load|dump)\()")
_BLOCK = re.compile(r"```([^\r\n]*)\r?\n([\s\S]*?)\r?\n```")
_YAML_CODE = re.compile(r"\b(?:apiVersion|kind|metadata|spec|containers|volumes|name|image|args|env|value):")
_SHELL_CODE = re.compile(r"\b(?:hf\s+download|pip|npm|docker|kubectl|git)\b", re.I)
_BARE_CODE = re.compile(r"\bdef\s+[A-Za-z_]\w*\s*\(|\bclass\s+[A-Za-z_]\w*\s*[:({]|\bfunction\s+[A-Za-z_$]\w*\s*\(|\b(?:const|let|var)\s+[A-Za-z_$]\w*\s*=|\bfrom\s+[A-Za-z_][\w.]*\s+import\s|\b(?:pip|npm)\s+install\b|(?:curl|wget)\s+https?://", re.I)


def block_fences(body: str) -> str:
    """Every code fence on a line of its own, the last one closed."""
    out: list[str] = []
    inside = False
    for line in re.split(r"\r\n|\r|\n", body):
        head, mark, tail = line.partition(FENCE)
        if not mark:
            out.append(line)
            continue
        parts = [head.rstrip()]
        if inside:
            parts += [FENCE, tail.strip()]
            inside = False
        else:
            code, close, after = tail.partition(FENCE)
            if close:
                out += [p for p in parts if p] + [FENCE, code.strip(), FENCE]
                parts = [after.strip()]
            elif tail[:1] in (" ", "\t"):
                parts += [FENCE, tail.strip()]
                inside = True
            else:
                parts.append(FENCE + tail.strip())
                inside = True
        out += [p for p in parts if p]
    return "\n".join([*out, FENCE] if inside else out)


def plain_markup(line: str) -> str:
    """A line of prose without the mark-up of papers."""
    text = html.unescape(line)
    for _ in range(5):  # arguments may hold arguments
        before = text
        for pattern, new in _NESTED:
            text = pattern.sub(new, text)
        if text == before:
            break
    for pattern, new in _FLAT:
        text = pattern.sub(new, text)
    return text.strip()


def outside_code(body: str, each: Callable[[str], str]) -> str:
    """``each`` applied to the lines that lie outside code."""
    out, inside = [], False
    for line in body.split("\n"):
        fence = line.lstrip().startswith(FENCE)
        out.append(line if fence or inside else each(line))
        inside ^= fence
    return "\n".join(out)


def normal_body(body: str) -> str:
    return outside_code(block_fences(body), plain_markup).strip()


def broken_up(code: str) -> str:
    """Code that lost its line breaks, broken where its kind (keys, commands, statements) shows them; other code as it is."""
    flat = re.sub(r"[ \t]+", " ", code).strip()
    if not flat or len(flat.splitlines()) > 2:
        return code
    keys = len(_YAML.findall(flat))
    if keys >= 8 or keys >= 4 and flat.startswith(("apiVersion:", "kind:", "---")):
        return re.sub(r"\s+(?=-\s+|#\s*)", "\n", re.sub(r"\s+(?=[A-Za-z_][\w.-]*:(?:\s|$))", "\n", flat))
    if len(_SHELL.findall(flat)) >= 2:
        return _SHELL.sub(lambda m: ("\n" if m.start() else "") + m[0], re.sub(r"\\\s+", "\\\n ", flat))
    if _PROGRAM.search(flat):
        lines = _STATEMENT.sub(lambda m: ";\n" if m[0] == ";" else m[0], flat)
        return re.sub(r":\s+(?=[A-Za-z_]\w*(?:\s|\[))", ":\n    ", _STARTS.sub("\n", lines))
    return code


def flattened(body: str) -> bool:
    """Whether a body holds code that lost its line breaks."""
    blocks = [c for _, c in _BLOCK.findall(body)]
    for code in blocks:
        if len([x for x in code.splitlines() if x.strip()]) <= 2 and len(code) >= 240 and (code.count(";") >= 2 or len(_SHELL_CODE.findall(code)) >= 2 or len(_YAML_CODE.findall(code)) >= 4):
            return True
    return not blocks and bool(_BARE_CODE.search(body))


def malformed(body: str) -> bool:
    return body.count(FENCE) % 2 == 1 or bool(re.search(r"(?m)^.*\S[ \t]+```[^\r\n`]*", body))


def repaired(body: str) -> str | None:
    """A damaged body put right; None if nothing was wrong or the code is still flat."""
    if not body or not (flattened(body) or malformed(body) or re.search(r"\\[A-Za-z]{2,}(?:\s*\{|\s|$)|(?<!\\)\$", _BLOCK.sub("", block_fences(body)))):
        return None
    out = _BLOCK.sub(lambda m: f"{FENCE}{m[1]}\n{broken_up(m[2])}\n{FENCE}", normal_body(body)).strip()
    return out if out and not flattened(out) else None


def each_text(f: Callable[[str], object], text: Column, kind: str = "string") -> Column:
    """``f`` over a column of texts in Arrow batches; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(text)

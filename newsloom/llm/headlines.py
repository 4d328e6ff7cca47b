"""Headlines as sparse vectors: folding, hashed n-grams, cells, signatures, and the exact comparison of two headlines."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import xxhash

#: Dimensions (hashed n-grams) of a vector, and the classes of them that share a weight.
DIM_BITS, CLASSES = 21, 1 << 18
#: Share of a vector's squared length that its cells must hold: the search radius (squared, relative).
RADIUS = 0.3
#: Shared n-grams (Dice) from which two headlines with the same numbers tell one story.
SIMILAR = 0.68
#: Share of a cut headline's n-grams that the whole one must have, and the share if the whole one begins like it.
CONTAINED, BEGINS = 0.9, 0.8
#: Words of 64 bits of a headline's signature.
SIGNATURE = 4
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_぀-ヿ㐀-鿿가-힯]+|[぀-ヿ㐀-鿿가-힯]")
_CUT = re.compile(r"\s*(?:…|\.{3,}|\[…\]|\[\.{3}\])\s*$")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
# fixed values: labels that announce a repost and tell nothing of the story
LABELS = re.compile(r"^\s*[\[\(【]?\s*(?:update[ds]?|breaking|new|exclusive|correction|corrected|live|watch|eilmeldung|aktualisiert|actualizado|última hora|mise à jour|urgent|atualizado|urgente|速報|更新|快讯|最新|突发|独家)\s*(?:[\]\)】]|[:：|–—-])\s*", re.I)
_SEPARATOR = re.compile(r"\s*[-–—|·:：]\s*")
_LAST = re.compile(r"\s+[-–—|·]\s+")


def plain_title(title: str | None) -> tuple[str, bool]:
    """A headline in one width, without invisible characters, emoji and doubled blanks; and whether it was cut."""
    t = title or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        odd = {c: k for c in set(t) if not c.isascii() and (k := unicodedata.category(c)) in ("So", "Sk", "Cs", "Co", "Mn", "Cf", "Cc")}
        if odd:
            t = "".join("" if odd.get(c) in ("Cf", "Cc") and not c.isspace() else " " if c in odd else c for c in t)
    t = " ".join("".join(c for c in t if c >= " " or c.isspace()).split() if not t.isprintable() else t.split())
    while (m := LABELS.match(t)) and m.end() < len(t):
        t = t[m.end() :].strip()
    if t.endswith(("…", "...", "]")) and (m := _CUT.search(t)):
        return t[: m.start()], True
    return t, False


def strip_site(t: str, names: frozenset[str]) -> str:
    """``t`` without a leading ``Site: `` or a trailing `` - Site`` that names a known source."""
    if not any(c in t for c in "-–—|·:："):
        return t
    for sep in _SEPARATOR.finditer(t) if ":" in t or "：" in t else ():
        if sep.group().strip() in (":", "：") and t[: sep.start()].casefold() in names:
            return t[sep.end() :]
    last = None
    for last in _LAST.finditer(t):
        pass
    if last and t[last.end() :].casefold() in names:
        return t[: last.start()]
    return t


def fold(t: str) -> str:
    """The words of a headline, in order, folded; punctuation doesn't count."""
    return " ".join(_WORD.findall(t.casefold().replace("ß", "ss")))


def numbers(folded: str) -> list[str]:
    return [w for w in folded.split() if w[0].isdigit()]


def number_key(folded: str) -> int:
    """One key per multiset of numbers: a dimension that outweighs all others."""
    return xxhash.xxh32_intdigest(" ".join(sorted(numbers(folded)))) >> 1


def word_class(word: str) -> int:
    return xxhash.xxh32_intdigest(f"w:{word}") & (CLASSES - 1)


def vectors(folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions of many headlines: (start of each, all dimensions, sorted and distinct within a headline).

    Dimensions are the hashed character 5-grams of the folded words, 3-grams where the script has no blanks.
    """
    size = np.zeros(len(folded), dtype=np.int64)
    parts, long = [], []
    for i, f in enumerate(folded):
        n = 3 if not f.isascii() and _CJK.search(f) else 5
        s = f" {f.replace(' ', '') if n == 3 else f} ".ljust(n)
        parts.append(s)
        size[i] = len(s)
        long.append(n == 5)
    if not parts:
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)
    text = "".join(parts)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    which = np.repeat(np.arange(len(folded)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters to the end of the headline
    with np.errstate(over="ignore"):
        padded = np.concatenate([c, np.zeros(4, np.uint64)])
        h = np.zeros(len(c), np.uint64)
        three = None
        for k in range(5):
            h = h * np.uint64(0x100000001B3) + padded[k : k + len(c)] * _PRIME
            if k == 2:
                three = h.copy()
        long_at = np.asarray(long)[which]
        h = np.where(long_at, h, three)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    ok = left >= np.where(long_at, 5, 3)
    key = np.sort(which[ok].astype(np.int64) << DIM_BITS | (h[ok] >> np.uint64(64 - DIM_BITS)).astype(np.int64))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return np.searchsorted(key >> DIM_BITS, np.arange(len(folded) + 1)), key & ((1 << DIM_BITS) - 1)


class Weights:
    """The weight of every class of dimensions, and the order in which dimensions go: heaviest first, the same for all headlines."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight
        self.place = np.empty(CLASSES, dtype=np.int64)
        order = np.lexsort((np.arange(CLASSES), -weight))
        self.place[order] = np.arange(CLASSES)
        self.square = weight[order].astype(np.float64) ** 2  # by place

    def ordered(self, starts: np.ndarray, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Headline, dimension and squared weight, heaviest first within a headline."""
        which = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))
        key = np.sort(which << DIM_BITS + 18 | self.place[dims & (CLASSES - 1)] << DIM_BITS | dims)
        return key >> DIM_BITS + 18, key & ((1 << DIM_BITS) - 1), self.square[key >> DIM_BITS & (CLASSES - 1)]


def cells_of(starts: np.ndarray, dims: np.ndarray, weights: Weights, radius: float = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Per headline the heaviest dimensions that together hold more than ``radius`` of the squared length: (headline, dimension)."""
    which, dims, w = weights.ordered(starts, dims)
    held = np.cumsum(w)
    before = np.concatenate([[0.0], held])
    total = before[starts[1:]] - before[starts[:-1]]
    kept = held - w - before[starts[:-1]][which] <= radius * total[which]
    return which[kept], dims[kept]


def signatures(starts: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` words of bits per headline, one bit a dimension: bits that differ are dimensions that differ."""
    n = len(starts) - 1
    which = np.repeat(np.arange(n), np.diff(starts))
    flags = np.zeros((n, 64 * SIGNATURE), dtype=np.uint8)
    flags[which, (dims * 2654435761 >> 15) % (64 * SIGNATURE)] = 1
    return np.packbits(flags, axis=1).view(np.int64)


def _near(a: str, b: str) -> bool:
    """Whether one word is a slip of the other: few edits, transpositions as one."""
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 2:
        return False
    most = 1 if max(len(a), len(b)) < 5 else 2 if max(len(a), len(b)) < 9 else 3
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return one[-1] <= most


def same_story(a: str, b: str, ga: np.ndarray, gb: np.ndarray, a_raw: str, b_raw: str, a_cut: bool, b_cut: bool, weight: np.ndarray) -> bool:
    """The exact rerank of a candidate pair of folded headlines with their full vectors."""
    shared = len(np.intersect1d(ga, gb, assume_unique=True))
    na, nb = numbers(a), numbers(b)
    wa, wb = Counter(a.split()), Counter(b.split())
    if a_cut or b_cut:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        gs = ga if short is a else gb
        if (a_cut if short is a else b_cut) and len(short) >= 12 and shared >= (CONTAINED if not long.startswith(short[: len(short) * 3 // 4]) else BEGINS) * len(gs):
            few, many = Counter(numbers(short)), Counter(numbers(long))
            rest = few - many
            # the last number of a cut headline may itself be cut
            return not rest or (len(list(rest.elements())) == 1 and short.split()[-1] in rest)
    if Counter(na) != Counter(nb):
        return False
    if 2 * shared < SIMILAR * (len(ga) + len(gb)):
        return False
    only_a, only_b = list((wa - wb).elements()), list((wb - wa).elements())
    for x in list(only_a):
        hit = next((y for y in only_b if _near(x, y)), None)
        if hit is not None:
            only_a.remove(x)
            only_b.remove(hit)
    if max(len(only_a), len(only_b)) > max(2, 0.3 * max(sum(wa.values()), sum(wb.values()))):
        return False
    # a name on either side that the other lacks: another product
    return not (_names(only_a, a_raw, weight) and _names(only_b, b_raw, weight))


def _names(words: list[str], raw: str, weight: np.ndarray) -> list[str]:
    latin = re.findall(r"[^\W\d_぀-ヿ㐀-鿿가-힯]+", raw)
    titled = len(latin) > 5 and sum(w[0].isupper() for w in latin) > 0.75 * len(latin)
    upper = {w.casefold() for w in latin if w[0].isupper()}
    return [w for w in words if w in upper and len(w) > 2 and not (titled and weight[word_class(w)] < 0.8 * weight.max())]

"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions, in numpy.

The tagger is trained from labelled spans (``pii_train``): invented pieces in carrier sentences, within sentences of a
bounded sample of the corpus. Texts are read in overlapping windows; each window is decoded, spans are kept from the
window in whose middle they lie, and joined across windows. An exact check of each kind then fixes a span's edges or
rejects it. Placeholders (``[EMAIL]``, ``[PHONE]``, ...) replace the pieces, the rest stays.

Null texts come out null, empty ones empty; neither holds pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_train import KINDS, labelled

WEIGHTS = Path(__file__).with_name("pii_weights.npz")
WINDOW, STRIDE = 240, 192
HIDDEN, EMBED, CHARS = 28, 20, 640
#: Labelled texts, corpus texts around them, passes of training.
LABELLED, SAMPLE, PASSES = 5_000, 1_500, 4
#: Share of the steps after which weights are averaged: single steps swing, their mean doesn't.
AVERAGED = 0.7
TAGS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
_COMMON = " etaoinshrdlucmfwypvbgkjqxzETAOINSHRDLUCMFWYPVBGKJQXZ0123456789@.,;:()[]{}\"'“”’-–—_+/\\*#%&=<>\n…。，、：；（）！？·ßäöüÄÖÜéèêàâçñáíóúãõºª＠"
_ID = {c: i + 2 for i, c in enumerate(_COMMON)}
#: Characters of names in scripts without blanks share hashed places.
_CAND = re.compile(r"\w")


def encode(text: str) -> np.ndarray:
    base = len(_COMMON) + 2
    return np.fromiter((_ID.get(c) or (base + zlib.crc32(c.encode()) % (CHARS - base) if not c.isspace() else 2) for c in text), dtype=np.int32, count=len(text))


class Tagger:
    """The network: embedding, two LSTMs, a layer to tags, transitions between tags."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.1: (r.standard_normal(s) * scale).astype(np.float32)
        t = len(TAGS)
        self.p = {"emb": f(CHARS, EMBED), "out": f(2 * HIDDEN, t), "ob": np.zeros(t, np.float32), "tr": np.zeros((t, t), np.float32), "st": np.zeros(t, np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": f(EMBED, 4 * HIDDEN, scale=0.2), f"wh{d}": f(HIDDEN, 4 * HIDDEN, scale=0.2), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        # a piece can only go on as what it began
        self.ban = np.zeros((t, t), np.float32)
        for j, tag in enumerate(TAGS):
            if tag[0] == "I":
                for i, before in enumerate(TAGS):
                    if before[2:] != tag[2:]:
                        self.ban[i, j] = -1e4

    def _lstm(self, x: np.ndarray, d: str, keep: bool = False) -> tuple:
        """Over ids [B, T]; returns outputs [T, B, H] and what the way back needs. Id 0 is padding and leaves no state."""
        p, h_ = self.p, HIDDEN
        # a gate is half a tanh of half its input, so one tanh serves gates and candidate
        half = np.r_[np.full(3 * h_, 0.5, np.float32), np.ones(h_, np.float32)]
        table = (p["emb"] @ p[f"wx{d}"] + p[f"b{d}"]) * half
        b, t = x.shape
        h, c = np.zeros((b, h_), np.float32), np.zeros((b, h_), np.float32)
        out = np.empty((t, b, h_), np.float32)
        kept = []
        wh = p[f"wh{d}"] * half
        x = np.ascontiguousarray(x)
        columns = np.ascontiguousarray(x.T)
        there = (x > 0).astype(np.float32)[:, :, None]
        ragged = not there.all(0).all(1)[-1]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[columns[k]]
            z += h @ wh
            np.tanh(z, out=z)
            i, f, o = (z[:, n * h_ : (n + 1) * h_] * 0.5 + 0.5 for n in (0, 1, 2))
            g = z[:, 3 * h_ :]
            before, hb = c, h
            c = f * c + i * g
            if ragged:
                c *= there[:, k]
            tc = np.tanh(c)
            h = o * tc
            out[k] = h
            if keep:
                kept.append((k, i, f, o, g, before, hb, tc))
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores [T, B, tags] of ids [B, T]; the two directions are never held side by side."""
        out = self.p["out"]
        return self._lstm(x, "f")[0] @ out[:HIDDEN] + self._lstm(x, "b")[0] @ out[HIDDEN:] + self.p["ob"]

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags [B, T] of emissions [T, B, tags]."""
        tr = self.p["tr"] + self.ban
        score = e[0] + self.p["st"] + np.where([g[0] == "I" for g in TAGS], 0.0, 0.0)
        back = np.empty(e.shape, np.int8)
        for k in range(1, len(e)):
            all_ = score[:, :, None] + tr[None]
            back[k] = all_.argmax(1)
            score = all_.max(1) + e[k]
        best = score.argmax(1)
        path = np.empty((e.shape[1], len(e)), np.int8)
        path[:, -1] = best
        row = np.arange(e.shape[1])
        for k in range(len(e) - 1, 0, -1):
            best = back[k][row, best]
            path[:, k - 1] = best
        return path

    def fit(self, texts: list[tuple[str, list[tuple[int, int, str]]]], passes: int = PASSES, batch: int = 32, rate: float = 0.007, verbose: bool = False) -> Tagger:
        """Maximises the CRF likelihood of the labelled spans with Adam."""
        order = sorted(range(len(texts)), key=lambda i: len(texts[i][0]))
        xs = [encode(texts[i][0]) for i in order]
        ys = []
        for i, x in zip(order, xs):
            y = np.zeros(len(x), np.int64)
            for a, b, k in texts[i][1]:
                n = 1 + 2 * KINDS.index(k)
                y[a:b] = n + 1
                y[a] = n
            ys.append(y)
        r = np.random.default_rng(1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, groups = 0, [list(range(i, min(i + batch, len(xs)))) for i in range(0, len(xs), batch)]
        total = passes * len(groups)
        mean = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.p.items()}
        summed = 0
        for _ in range(passes):
            r.shuffle(groups)
            for g in groups:
                t = max(len(xs[i]) for i in g)
                x, y, mask = np.zeros((len(g), t), np.int32), np.zeros((len(g), t), np.int64), np.zeros((len(g), t), np.float32)
                for n, i in enumerate(g):
                    x[n, : len(xs[i])], y[n, : len(xs[i])], mask[n, : len(xs[i])] = xs[i], ys[i], 1
                grad = self._gradient(x, y, mask)
                step += 1
                if step % 200 == 0 and verbose:
                    print(step, total, round(self.loss, 3), flush=True)
                lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / total)
                norm = np.sqrt(sum(float((q * q).sum()) for q in grad.values()))
                for k, q in grad.items():
                    q = q * min(1.0, 5.0 / (norm + 1e-6))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v2[k] = 0.99 * v2[k] + 0.01 * q * q
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                if step > total * AVERAGED:
                    summed += 1
                    for k in mean:
                        mean[k] += self.p[k]
        if summed:
            self.p = {k: (v / summed).astype(np.float32) for k, v in mean.items()}
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        p, h_ = self.p, HIDDEN
        b, t = x.shape
        of, kf = self._lstm(x, "f", True)
        ob, kb = self._lstm(x, "b", True)
        hid = np.concatenate([of, ob], axis=2)
        e = hid @ p["out"] + p["ob"]
        tr = p["tr"] + self.ban
        nt = len(TAGS)
        # forward and backward sums, in log space
        a = np.empty((t, b, nt), np.float32)
        a[0] = e[0] + p["st"]
        etr = np.exp(tr)
        for k in range(1, t):
            top = a[k - 1].max(1, keepdims=True)
            new = np.log(np.exp(a[k - 1] - top) @ etr + 1e-30) + top + e[k]
            a[k] = np.where(mask[:, k : k + 1] > 0, new, a[k - 1])
        bt = np.zeros((t, b, nt), np.float32)
        for k in range(t - 2, -1, -1):
            s = bt[k + 1] + e[k + 1]
            top = s.max(1, keepdims=True)
            new = np.log(np.exp(s - top) @ etr.T + 1e-30) + top
            bt[k] = np.where(mask[:, k + 1 : k + 2] > 0, new, 0.0)
        z = a[-1].max(1, keepdims=True)
        z = np.log(np.exp(a[-1] - z).sum(1, keepdims=True)) + z
        row = np.arange(b)
        best = e[0, row, y[:, 0]] + p["st"][y[:, 0]]
        for k in range(1, t):
            best = best + (e[k, row, y[:, k]] + tr[y[:, k - 1], y[:, k]]) * mask[:, k]
        self.loss = float((z[:, 0] - best).mean())
        de = np.exp(np.minimum(a + bt - z[None], 0)) * mask.T[:, :, None]
        gold = np.zeros_like(de)
        gold[np.arange(t)[:, None], np.arange(b)[None], y.T] = mask.T
        gtr = np.zeros((nt, nt), np.float32)
        for k in range(1, t):
            w = mask[:, k : k + 1]
            top = a[k - 1].max(1, keepdims=True)
            left = np.exp(a[k - 1] - top) * w
            right = np.exp(np.minimum(e[k] + bt[k] + top - z, 60)) * w
            gtr += (left.T @ right) * etr
            np.add.at(gtr, (y[:, k - 1], y[:, k]), -w[:, 0])
        scale = 1.0 / b
        de = (de - gold) * scale
        grad = {"st": de[0].sum(0), "tr": np.where(self.ban < 0, 0, gtr * scale).astype(np.float32), "ob": de.sum((0, 1)), "out": np.einsum("tbh,tbn->hn", hid, de, optimize=True)}
        dh_all = de @ p["out"].T
        demb = np.zeros_like(p["emb"])
        for d, kept, off in (("f", kf, 0), ("b", kb, h_)):
            dwh, dtab = np.zeros_like(p[f"wh{d}"]), np.zeros((CHARS, 4 * h_), np.float32)
            dh, dc = np.zeros((b, h_), np.float32), np.zeros((b, h_), np.float32)
            zs = np.empty((t, b, 4 * h_), np.float32)
            for k, i, f, o, g, before, hb, tc in reversed(kept):
                dh = dh + dh_all[k, :, off : off + h_]
                do = dh * tc
                dc = (dc + dh * o * (1 - tc * tc)) * mask[:, k : k + 1]
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dwh += hb.T @ dz
                zs[k] = dz
                dh, dc = dz @ p[f"wh{d}"].T, dc * f
            flat, ids = zs.reshape(-1, 4 * h_), x.T.reshape(-1)
            order = np.argsort(ids, kind="stable")
            u, first = np.unique(ids[order], return_index=True)
            dtab[u] = np.add.reduceat(flat[order], first, axis=0)
            grad[f"wh{d}"], grad[f"b{d}"], grad[f"wx{d}"] = dwh, dtab.sum(0), p["emb"].T @ dtab
            demb += dtab @ p[f"wx{d}"].T
        grad["emb"] = demb
        return grad


def windows(n: int) -> list[int]:
    """Starts of the windows over a text of ``n`` characters."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Decoded spans (start, end, kind) of every text, reconciled across windows."""
    place, rows = [], []
    for i, text in enumerate(texts):
        x = encode(text)
        for a in windows(len(text)):
            part = x[a : a + WINDOW]
            rows.append(np.pad(part, (0, WINDOW - len(part))))
            place.append((i, a, len(part)))
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    edge = (WINDOW - STRIDE) // 2
    moves = tagger.p["tr"] + tagger.ban
    lift = moves[:, 1:].max(0) - moves[0, 0]
    order = sorted(range(len(rows)), key=lambda i: place[i][2])  # windows of one length go together, so little padding is read
    rows, place = [rows[i] for i in order], [place[i] for i in order]
    for at in range(0, len(rows), 1024):
        x = np.stack(rows[at : at + 1024])[:, : place[min(at + 1023, len(rows) - 1)][2]]
        if not x.shape[1]:
            continue
        e = tagger.emissions(x)
        # a window in which no character comes near a piece, transitions counted, is plain text
        some = np.flatnonzero(((e[:, :, 1:] + lift).max(2) > e[:, :, 0] - 2.0).any(0))
        if not len(some):
            continue
        for path, w in zip(tagger.viterbi(e[:, some]), some):
            i, a, n = place[at + w]
            k = 0
            while k < n:
                if path[k] == 0:
                    k += 1
                    continue
                kind, end = (path[k] - 1) // 2, k + 1
                while end < n and path[end] == 2 + 2 * kind:
                    end += 1
                middle = a + (k + end) / 2
                if (middle >= a + edge or a == 0) and (middle < a + WINDOW - edge or a + n == len(texts[i])):
                    found[i].append((a + k, a + end, KINDS[kind]))
                k = end
    return [merge(s) for s in found]


def merge(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order; those of one kind that touch or overlap are one, of two kinds that overlap the longer stays."""
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(found):
        if out and a < out[-1][1]:
            if out[-1][2] == k:
                out[-1] = (out[-1][0], max(b, out[-1][1]), k)
            elif b - a > out[-1][1] - out[-1][0]:
                out[-1] = (a, b, k)
            continue
        out.append((a, b, k))
    return out


_AT = r"\s?(?:@|＠|\(at\)|\[at\]|\{at\}|%40|&#64;)\s?"
_DOT = r"\.|\s?\(dot\)\s?|\s?\[dot\]\s?| (?:dot|punto) "
_EXACT = {
    "email": re.compile(rf"[A-Za-z0-9][\w.+-]*(?:{_AT}[A-Za-z0-9-]+(?:(?:{_DOT})[A-Za-z0-9-]+)+| (?:at|arroba) [A-Za-z0-9-]+(?: (?:dot|punto) [A-Za-z0-9-]+)+)", re.I),
    "phone": re.compile(r"(?<![A-Za-z0-9.-])(?:\+|00)?\(?\d{1,4}\)?(?:[ .()/-]{0,2}\d{1,9}){0,7}(?![A-Za-z0-9])"),
    "id_number": re.compile(r"(?<![A-Za-z0-9])[A-Z]{0,2}\d(?:[ .-]?\d){5,17}(?:-?[A-Z])?(?![A-Za-z0-9])"),
}
_WORD = re.compile(r"[^\W\d_]")
#: What stands before a street's name within its address.
_STREET = re.compile(
    r"(?:\d{1,4}[a-z]?(?: bis| ter)?,? (?:rue|avenue|allée|boulevard|impasse|place|chemin|quai) (?:de la |de |du |des |d’|l’)?|(?:Calle|Avenida|Avda\.|Paseo|Plaza|Rua|Travessa|Praça|Largo) (?:de la |de |del |da |do )?"
    r"|[^\W\d_]+(?:straße|strasse|weg|platz|allee|gasse|str\.) |\d{1,4}[a-z]? )$"
)
_TITLE = re.compile(r"^(?:(?:Dr|Prof|Mr|Mrs|Ms|Mme|Mlle|M|Sr|Sra|Herr|Frau|Señor|Señora|Don|Doña|Sir)\.?\s+)+")


def check(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The exact check: edges are set to whole pieces, spans that can't be of their kind are dropped."""
    out = []
    for a, b, k in found:
        if k in _EXACT:
            lo = max(0, a - 24)
            best = None
            for m in _EXACT[k].finditer(text, lo, min(len(text), b + 24)):
                over = min(b, m.end()) - max(a, m.start())
                if over >= 0.5 * (b - a) and (best is None or over > best[0]):
                    best = (over, m.start(), m.end())
            if best is None:
                continue
            end = b
            a, b = best[1], best[2]
            if k != "email" and b > end + 3:  # a number that only stands behind the piece
                run = [m.end() for m in re.finditer(r"\d+", text[a:b]) if a + m.end() <= end + 2]
                b = a + run[-1] if run else b
            digits = sum(c.isdigit() for c in text[a:b])
            if k == "phone" and not 7 <= digits <= 15 or k == "id_number" and digits < 6:
                continue
            if k == "email" and (text[max(0, a - 1) : a] == "@" or text[a:b].lower().startswith("git@") or text[b : b + 1] == ":"):
                continue
        elif k == "person":
            while a > 0 and text[a].isascii() and (text[a - 1].isascii() and _WORD.match(text[a - 1]) or a > 1 and text[a - 1] == "-" and text[a - 2].isalpha()):
                a -= 1
            while b < len(text) and text[b - 1].isascii() and text[b].isascii() and _WORD.match(text[b]):
                b += 1
            m = _TITLE.match(text[a:b])
            a += m.end() if m else 0
            piece = text[a:b]
            a += len(piece) - len(piece.lstrip(" ,.;:\"'“”()<>"))
            piece = text[a:b].rstrip(" ,;:\"'“”()<>")
            b = a + len(piece)
            if b - a < 2 or piece[:1].islower() or any(c.isdigit() for c in piece) or "@" in piece or piece.isascii() and not re.search(r"[\s,-]", piece):
                continue
        else:
            while a > 0 and text[a - 1].isalnum() and text[a].isalnum() and text[a].isascii():
                a -= 1
            while b < len(text) and text[b - 1].isalnum() and text[b].isalnum() and text[b].isascii():
                b += 1
            piece = text[a:b]
            a += len(piece) - len(piece.lstrip(" ,.;:\"'()"))
            b = a + len(text[a:b].rstrip(" ,;:\"'("))
            if m := _STREET.search(text, max(0, a - 40), a):
                a = m.start()
            if b - a < 6 or not any(c.isdigit() for c in text[a:b]):
                continue
        out.append((a, b, k))
    out = merge(out)
    mails = [(a, b) for a, b, k in out if k == "email"]
    return [(a, b, k) for a, b, k in out if k == "email" or not any(a < y and b > x for x, y in mails)]


def replace(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` in place of every span."""
    out, at = [], 0
    for a, b, k in found:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def load() -> Tagger | None:
    """The tagger that ``python -m newsloom.llm.pii`` trained, if its weights fit this network; else None."""
    try:
        with np.load(WEIGHTS) as got:
            tagger = Tagger()
            if all(k in got.files and got[k].shape == v.shape for k, v in tagger.p.items()):
                tagger.p = {k: got[k] for k in tagger.p}
                return tagger
    except OSError:
        pass
    return None


def trained(texts: DataFrame, text: str, names: DataFrame, size: int = LABELLED, passes: int = PASSES) -> Tagger:
    """A tagger from the known names (``name``, ``role``) and at most ``SAMPLE`` texts of the corpus (those of smallest hash)."""
    rows = names.where(F.col("name").isNotNull()).select("name", "role").orderBy("name").collect()
    corpus = [r[0] for r in texts.where(F.length(text) > 0).orderBy(F.xxhash64(text), text).select(text).limit(SAMPLE).collect()]
    given, family = ([r["name"] for r in rows if r["role"] == role] for role in ("given", "family"))
    return Tagger().fit(labelled(given, family, corpus, size), passes)


def find(texts: DataFrame, ident: str, text: str, tagger: Tagger) -> DataFrame:
    """Per text: ``ident``, ``clean`` (with placeholders), ``pieces`` (array of start_pos, end_pos, kind; from 1)."""
    shared = texts.sparkSession.sparkContext.broadcast(tagger)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at in range(0, len(df), 500):  # bounds the memory of a task
                part = df.iloc[at : at + 500]
                bodies = [t or "" for t in part["_text"]]
                got = [check(t, s) for t, s in zip(bodies, spans(shared.value, bodies))]
                yield pd.DataFrame(
                    {"_id": part["_id"].to_numpy(), "clean": [None if t is None else replace(t, s) for t, s in zip(part["_text"], got)], "pieces": [[{"start_pos": a + 1, "end_pos": b, "kind": k} for a, b, k in s] for s in got]}
                )

    kind = texts.schema[ident].dataType.simpleString()
    # decoding is the work: texts are dealt evenly, whatever the files
    dealt = texts.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "_id")
    out = dealt.mapInPandas(tag, f"_id {kind}, clean string, pieces array<struct<start_pos:int,end_pos:int,kind:string>>")
    return out.withColumnRenamed("_id", ident)


def main(documents: str, names: str, size: int = 30_000, passes: int = 4) -> None:
    """Trains the tagger on the labelled spans and writes its weights beside this module."""
    import pyarrow.dataset as ds

    rows = ds.dataset(names).to_table().to_pylist()
    given, family = (sorted(r["name"] for r in rows if r["role"] == role and r["name"]) for role in ("given", "family"))
    corpus = sorted((t for t in ds.dataset(documents).to_table(["text"])["text"].to_pylist() if t), key=lambda t: zlib.crc32(t.encode()))[:SAMPLE]
    np.savez_compressed(WEIGHTS, **Tagger().fit(labelled(given, family, corpus, size), passes, verbose=True).p)


if __name__ == "__main__":
    import sys

    main(*sys.argv[1:3])

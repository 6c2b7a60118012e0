"""Personal data by a skip-chain conditional random field over the base patterns.

Variables are a document's candidate tokens (runs without white space that hold a digit or '@'), labelled O or one
of the kinds. Neighbouring candidates are chained; a token is also tied, by a skip edge, to the previous token with
the same key (its digits if it has seven or more, the last seven of them, or its lower-case text), however far away.
Loopy sum-product messages make distant mentions agree, so a mention that no pattern takes by itself (a number
repeated without its prefix, say) is added. Weights are trained by pseudo-likelihood on base matches of a bounded
sample; base spans always stay and added ones never overlap them.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_cut

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Documents that the field's weights are trained on at most.
FIT_ROWS = 3000
#: Bytes of their texts at most.
FIT_BYTES = 32 << 20
LEAST = 0.5  # posterior of an added span
_DIGITS = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DROP = re.compile(r"[^0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_TOKEN = re.compile(r"[0-9@]")
_WHITE = re.compile(r"\s")
L, NF = 5, 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(t: str):
    """As finditer of the pattern; a long run without '@' behind it is skipped as a whole."""
    at = t.find("@")
    done = 0
    while at >= 0:
        s = at  # the run of local characters that ends at this '@'
        while s > done and _LOCAL.fullmatch(t[s - 1]):
            s -= 1
        m = PATTERNS["email"].match(t, s) if s < at else None
        if m:
            yield m
            done = m.end()
            at = t.find("@", done)
        else:
            at = t.find("@", at + 1)


def _ips(t: str):
    """(start, end, parts) as finditer of the pattern gives them: the fours of each run of dotted numbers.

    Linear: each run is read once, where the pattern alone would read a run of n digits n times.
    """
    for run in _DOTTED.finditer(t):
        at, parts = run.start(), run[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, four
            at = end + 1


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in _emails(t)] if "@" in t else []
    if _DIGITS.search(t):
        if "." in t:
            out += [(s, 1, e) for s, e, parts in _ips(t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts)]
        for m in PATTERNS["card"].finditer(t):
            if m.end() - m.start() >= 12 and 12 <= len(d := _DROP.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in t:
            out += [(m.start(), 3, m.end()) for m in PATTERNS["phone"].finditer(t) if 9 <= len(_DROP.sub("", m[0])) <= 15]
    return sorted(out)


def _tokens(t: str) -> list[tuple[int, int]]:
    """Trimmed (start, end) of the candidate tokens."""
    out, done = [], 0
    for m in _TOKEN.finditer(t):
        if m.start() < done:
            continue
        s, e = m.start(), m.end()
        while s > done and not t[s - 1].isspace():
            s -= 1
        w = _WHITE.search(t, e)
        done = e = w.start() if w else len(t)
        while e > s and not (t[e - 1].isalnum()):
            e -= 1
        while s < e and not (t[s].isalnum() or t[s] == "+"):
            s += 1
        if e > s:
            out.append((s, e))
    return out


def _features(t: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(tokens), NF))
    for i, (s, e) in enumerate(tokens):
        w = t[s:e]
        d = _DROP.sub("", w)
        n, quad = len(d), w.split(".")
        alpha = any(c.isalpha() for c in w)
        x[i, 0] = 1
        x[i, 1] = "@" in w
        x[i, 2] = bool(PATTERNS["email"].fullmatch(w))
        x[i, 3] = len(quad) == 4 and all(q.isdecimal() and len(q) < 4 and int(q) < 256 for q in quad)
        x[i, 4] = w[0] == "+" or (s > 0 and t[s - 1] == "+")
        x[i, 5] = alpha
        x[i, 6] = "=" in w or ":" in w
        x[i, 7] = 12 <= n <= 19 and not alpha and luhn(d)
        x[i, 8 + min(7, n // 2)] = 1
        x[i, 16] = len(d) == len(w)
        x[i, 17] = "-" in w
        x[i, 18] = "(" in t[max(0, s - 1) : e + 1]
        x[i, 19] = i > 0 and s - tokens[i - 1][1] <= 3
        x[i, 20] = i + 1 < len(tokens) and tokens[i + 1][0] - e <= 3
        x[i, 21] = i > 0 and x[i - 1, 4] > 0 and s - tokens[i - 1][1] <= 3
        x[i, 22] = len(w) > 24
        x[i, 23] = 9 <= n <= 15 and not alpha
    return x


def _edges(t: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, type): 0 chains tokens at most three characters apart, 1 is a skip edge. Linear in the tokens."""
    out = [(i - 1, i, 0) for i in range(1, len(tokens)) if tokens[i][0] - tokens[i - 1][1] <= 3]
    last: dict[str, int] = {}
    for i, (s, e) in enumerate(tokens):
        w = t[s:e].lower()
        d = _DROP.sub("", w)
        keys = ["=" + (d if len(d) >= 7 else w)] + (["~" + d[-7:]] if len(d) >= 9 else [])
        for j in {last[k] for k in keys if k in last}:
            out.append((j, i, 1))
        last.update(dict.fromkeys(keys, i))
    return out


def _labels(tokens, base) -> np.ndarray:
    y, k = np.zeros(len(tokens), np.int64), 0
    for i, (s, e) in enumerate(tokens):
        for b, kind, f in base:
            if b < e and f > s:
                y[i] = kind + 1
                break
    return y


def train(texts: list[str], steps: int = 250) -> np.ndarray:
    """Weights of shape (features + 2 L, L): nodes, chain edges, skip edges, by pseudo-likelihood."""
    xs, ys = [], []
    for t in texts:
        tok = _tokens(t)
        if not tok:
            continue
        y = _labels(tok, base_spans(t))
        near = np.zeros((len(tok), 2 * L))
        for i, j, k in _edges(t, tok):
            near[i, k * L + y[j]] += 1
            near[j, k * L + y[i]] += 1
        xs.append(np.hstack([_features(t, tok), near]))
        ys.append(y)
    w = np.zeros((NF + 2 * L, L))
    if not xs:
        return w
    x, y = np.vstack(xs), np.concatenate(ys)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):  # Adam
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ p / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    for k in range(2):  # edge potentials are symmetric
        b = w[NF + k * L : NF + (k + 1) * L]
        b[:] = (b + b.T) / 2
    return w


def _swept(node, src, dst, pot, back, msg, sweeps: int = 25) -> np.ndarray:
    """Messages edge by edge, up the tokens and down again, until none moves by 1e-3.

    A sweep carries what is known along chains of any length, and is linear in the edges; a field with loops that does
    not settle stops after ``sweeps``.
    """
    msg, total = msg.copy(), node.copy()
    np.add.at(total, dst, msg)
    up, down = np.flatnonzero(src < dst), np.flatnonzero(src > dst)
    order = [*up[np.argsort(dst[up], kind="stable")].tolist(), *down[np.argsort(-dst[down], kind="stable")].tolist()]
    for _ in range(sweeps):
        most = 0.0
        for e in order:
            z = (total[src[e]] - msg[back[e]])[:, None] + pot[e]
            top = z.max(axis=0)
            new = np.log(np.exp(z - top).sum(axis=0)) + top
            new -= new.max()
            moved = new - msg[e]
            total[dst[e]] += moved
            msg[e] = new
            most = max(most, float(np.abs(moved).max()))
        if most < 1e-3:
            break
    return msg


def posterior(x: np.ndarray, edges: list[tuple[int, int, int]], w: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Marginals by loopy sum-product messages: damped, all edges at once, and by sweeps if those have not settled.

    A round moves what is known by one edge, so long chains of mentions need the sweeps (see :func:`_swept`).
    """
    node = x @ w[:NF]
    if edges:
        a = np.array(edges)
        src, dst, kind = np.concatenate([a[:, 0], a[:, 1]]), np.concatenate([a[:, 1], a[:, 0]]), np.tile(a[:, 2], 2)
        pot = np.stack([w[NF : NF + L], w[NF + L :]])[kind]
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(src), L))
        for _ in range(rounds):
            total = node.copy()
            np.add.at(total, dst, msg)
            z = (total[src] - msg[back])[:, :, None] + pot
            top = z.max(axis=1, keepdims=True)
            new = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            new = 0.5 * msg + 0.5 * new
            if np.abs(new - msg).max() < 1e-3:
                msg = new
                break
            msg = new
        else:
            msg = _swept(node, src, dst, pot, back, msg)
        node = node.copy()
        np.add.at(node, dst, msg)
    p = np.exp(node - node.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans_of(text: str | None, w: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans with those that the field adds; only tokens tied by a skip edge can be added."""
    t = text or ""
    base = base_spans(t)
    tok = _tokens(t)
    edges = _edges(t, tok)
    if not any(k for _, _, k in edges):
        return base, base
    p = posterior(_features(t, tok), edges, w)
    tied = {i for a, b, k in edges if k for i in (a, b)}
    best, added, starts = p.argmax(axis=1), [], [b[0] for b in base]
    for i in sorted(tied):
        s, e = tok[i]
        k = int(np.searchsorted(starts, e)) - 1  # the last base span that starts before e
        free = not any(b < e and f > s for b, _, f in base[max(0, k - 8) : k + 1])
        if best[i] and p[i, best[i]] >= LEAST and free:
            added.append((s, int(best[i]) - 1, e))
    return base, sorted(base + added)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> np.ndarray:
    """Trains on distinct whole texts with candidates: at most ``fit_rows``, of the smallest text hashes, ``fit_bytes`` in all.

    A text that no longer fits is passed over, but the first is always taken. Warns if there is none to train on.
    """
    t = docs.select("text").where(F.col("text").rlike("[0-9@]")).withColumn("o", F.xxhash64("text"))
    last = hash_cut(t, "o", fit_rows, t.agg(F.approx_count_distinct("o")).first()[0])
    if last is None:
        warnings.warn("personal data: no text with a digit or '@' to train on; nothing is added to the patterns' matches", stacklevel=2)
        return train([])
    t, left, taken = t.where(F.col("o") <= last), fit_bytes, []
    for o, n in sorted(map(tuple, t.groupBy("o").agg(F.max(F.octet_length("text"))).collect())):  # fit_rows at most
        if n <= left or not taken:
            left -= n
            taken.append(o)
    # equal texts have one hash and come once; summed map-side, so their number moves nothing
    return train([x for _, x in sorted(map(tuple, t.where(F.col("o").isin(taken)).groupBy("o").agg(F.min("text")).toLocalIterator()))])


def find_pii(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Positions are code points, ends exclusive. Null texts are empty ones; repeated rows get equal rows; an empty
    table gives none; other columns are ignored. Counts and base_sha256 are of the base spans.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    w = fit(docs) if weights is None else weights

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                base, every = spans_of(t, w)
                n = [0] * len(KINDS)
                for _, k, _ in base:
                    n[k] += 1
                rows.append((i, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """docs with every span of its text, base or added, replaced by its kind in brackets; other columns stay."""
    w = fit(docs) if weights is None else weights

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s, k, e in spans_of(t, w)[1]:
                if e <= at:
                    continue
                parts += [t[at : max(at, s)], f"[{KINDS[k]}]"]
                at = e
            out.append("".join([*parts, t[at:]]) if at else t)
        return pd.Series(out)

    return docs.withColumn("text", masked(F.col("text").cast("string"))).select(*docs.columns)



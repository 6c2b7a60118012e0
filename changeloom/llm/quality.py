"""Quality classifier: naive Bayes support vectors.

N-gram indicators of a whole text (bytes, character classes and words' repetition) are hashed into a fixed number of
buckets and scaled by the class log-count ratios of their buckets, taken over all labelled training documents. A
linear hinge-loss model is fitted to a bounded sample of them by dual coordinate descent, and its margin is made a
probability by a logistic curve fitted to margins of documents that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_cut, mix64, sized, stored
from .textops import pieces

BITS = 18
#: Labelled documents that the linear model is fitted to at most; counts are of all of them.
FIT_ROWS = 6000
DROP_BELOW = 0.3

_CLASS = np.full(256, 7, np.uint8)  # other punctuation keeps its byte below
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_CLASS[[32, 9]], _CLASS[[10, 13]] = 4, 5
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 16 + _c


class Buckets:
    """Distinct bucket numbers of a text's n-grams. A table of last writers makes them distinct without sorting."""

    def __init__(self, bits: int = BITS):
        self.bits, self.last = bits, np.zeros(1 << bits, np.int32)

    def of(self, text: str | None) -> np.ndarray:
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        shift = np.uint32(32 - self.bits)
        codes = []

        def grams(x: np.ndarray, n: int, kind: int) -> None:
            if len(x) < n:
                return
            h = np.full(len(x) - n + 1, kind, np.uint32)
            for j in range(n):
                h = (h ^ x[j : j + len(h)]) * np.uint32(0x01000193 + 2 * j)
            codes.append((h * np.uint32(0x9E3779B1)) >> shift)

        raw = b.astype(np.uint32)
        grams(raw, 2, 1)
        grams(raw, 4, 2)
        c = _CLASS[b]
        runs = c[np.flatnonzero(np.diff(c, prepend=np.uint8(0)))].astype(np.uint32) if len(c) else raw
        for n in (1, 2, 3, 5):
            grams(runs, n, 16 + n)
        codes.append(self._words(b) >> shift)
        h = np.concatenate(codes).astype(np.int64)
        at = np.arange(len(h), dtype=np.int32)
        self.last[h] = at
        return h[self.last[h] == at].astype(np.int32)

    @staticmethod
    def _words(b: np.ndarray) -> np.ndarray:
        """Indicators of the length and of the shares of distinct words, of repeated neighbours and of word bigrams."""
        seed = np.uint32(0x85EBCA6B)
        white = (b == 32) | ((b >= 9) & (b <= 13))
        start = np.flatnonzero(~white & np.concatenate([[True], white[:-1]])) if len(b) else np.zeros(0, np.int64)
        n = len(start)
        facts = [n.bit_length()]
        if n:
            at = np.arange(len(b)) - start[np.maximum(np.searchsorted(start, np.arange(len(b)), "right") - 1, 0)]
            h = mix64(b.astype(np.uint64) + (at.astype(np.uint64) << np.uint64(8)))
            h[white] = 0
            w = np.add.reduceat(h, start)
            two = mix64(w[:-1]) + w[1:]
            facts += [64 + 20 * len(np.unique(w)) // n, 128 + int(20 * (w[1:] == w[:-1]).mean()) if n > 1 else 127, 192 + 20 * len(np.unique(two)) // max(1, n - 1), 256 + min(40, len(b) // n)]
        return (np.array(facts, np.uint32) * np.uint32(0x9E3779B1)) ^ seed


@dataclass
class Model:
    weights: np.ndarray  # of buckets, ratios included
    bias: float
    slope: float
    offset: float
    bits: int

    def scores(self, texts) -> np.ndarray:
        find, out = Buckets(self.bits), np.empty(len(texts))
        for i, t in enumerate(texts):
            x = find.of(t)
            out[i] = self.weights[x].sum(dtype=np.float64) / np.sqrt(max(1, len(x))) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * out + self.offset, -30, 30)))


def _descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; c is each row's cost."""
    rng, w, bias = np.random.default_rng(11), np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    q = np.array([(scale[r] ** 2).sum() / max(1, len(r)) + 1.0 for r in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r] / np.sqrt(max(1, len(r)))
            g = y[i] * (w[r] @ x + bias) - 1.0
            a = min(max(alpha[i] - g / q[i], 0.0), c[i])
            if (step := (a - alpha[i]) * y[i]) != 0.0:
                w[r] += step * x
                bias += step
                alpha[i] = a
                moved += abs(step)
        if moved < 1e-4 * len(rows):
            break
    return w, bias


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps, lightly regularised
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * m).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(v * m * m).sum() + 1e-2, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS, epochs: int = 15) -> Model:
    """Learns ``labels.quality`` (0 or 1; other values are ignored) from whole texts of the labelled documents.

    Bucket counts are of all labelled documents, summed in the workers before they are shuffled, and at most
    2 ** bits rows reach the driver. The hinge-loss model sees at most ``fit_rows`` of them (those with the smallest
    hashes of doc_id); a fifth of these is held back for the logistic curve. With one class only, or no labels, the
    score is the smoothed share of label 1. A doc_id with several labels counts with the larger one; each row of
    docs of a labelled doc_id counts.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").cast("int").alias("y"))
    known = known.withColumn("o", F.xxhash64("l_id", F.lit(5)))
    known = stored(known, "labels")
    n1, n = (int(x or 0) for x in known.agg(F.sum("y"), F.count("*")).first())
    if n1 in (0, n):
        return Model(np.zeros(1 << bits), 0.0, 1.0, float(np.log((n1 + 1) / (n - n1 + 1))), bits)
    cut = hash_cut(known, "o", fit_rows, n)
    t = docs.select("doc_id", "text").join(sized(known), F.col("doc_id") == F.col("l_id")).select("text", "y", "o")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, sums = Buckets(bits), np.zeros((2, 1 << bits), np.int64)
        for pdf in frames:
            rows = []
            for text, y, o in pdf[["text", "y", "o"]].itertuples(index=False):
                x = find.of(text)
                sums[y][x] += 1
                if o <= cut:
                    rows.append((None, y, o, x.tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["bucket", "y", "n", "x"])
        for y in (0, 1):
            b = np.flatnonzero(sums[y])
            yield pd.DataFrame({"bucket": b, "y": y, "n": sums[y][b], "x": None})

    got = stored(t.mapInPandas(learn, "bucket long, y int, n long, x binary"), "buckets")
    sums = np.zeros((2, 1 << bits))
    for b, y, s in got.where("bucket is not null").groupBy("bucket", "y").agg(F.sum("n")).toLocalIterator():
        sums[y][b] = s
    p, q = sums[1] + 1.0, sums[0] + 1.0
    scale = np.log((p / p.sum()) / (q / q.sum()))
    # one row for each hash, so at most fit_rows; fetched partition by partition into one buffer
    one = got.where("bucket is null").groupBy("n").agg(F.min(F.struct("y", "x")).alias("s")).select("n", "s.y", "s.x")
    held, facts = bytearray(), []
    for o, y, x in one.toLocalIterator():
        facts.append((o, y, len(held) // 4, len(x) // 4))
        held += x
    facts = sorted(facts)[:fit_rows]
    flat = np.frombuffer(held, np.int32)
    rows = [flat[at : at + size] for _, _, at, size in facts]
    y = np.array([f[1] for f in facts])
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back = np.zeros(len(y), bool)
    cost = np.where(y == 1, 1.0, max(1.0, (y == 1).sum() / max(1, (y == 0).sum())) ** 0.5)
    train = np.flatnonzero(~back)
    w, bias = _descend([rows[i] for i in train], scale, 2.0 * y[train] - 1, cost[train], epochs)
    weights = w * scale
    test = np.flatnonzero(back) if back.any() else train
    m = np.array([weights[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias for i in test])
    return Model(weights, bias, *_logistic(m, y[test]), bits)


def score(docs: DataFrame, model: Model, threshold: float = DROP_BELOW) -> DataFrame:
    """All columns of docs with score (0 to 1, likelihood of label 1) and predicted (1 from ``threshold`` on) added.

    Null texts are scored as empty ones. Columns of these names that docs has already are replaced. The model, of a
    fixed number of buckets, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        out = np.empty(len(text))
        texts = text.tolist()
        for a, b in pieces(texts):
            out[a:b] = sent.value.scores(texts[a:b])
        return pd.Series(out)

    d = docs.drop("score", "predicted").withColumn("score", of(F.col("text").cast("string")))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are within a squared distance of 2 - 2c. A seeded rotation spreads that distance;
split into blocks, at least one block has its proportional share or less. Each block is range-joined on a grid over
its first coordinates, as many as the label's number of vectors is worth. Cells are twice the block's radius wide, and
a vector is a guest in the neighbouring cells that the ball of that radius around it meets. Cells hold the block's
coordinates only. The rows of a cell that are within the block's budget of another get their vectors back, and every
such pair is verified on the original vectors in double precision, counted by the first block that finds it. Heavy cells
are cut into tiles, so a task's memory is bounded; pairs are never emitted: a tile gives link counts and a star per
local group of linked vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_stored, mix64, roots, sized, stored

BLOCK, TILE, SLACK = 8, 1500, 1e-9
#: Time of a row in a cell, in tests of two rows.
ROW = 1000


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _split(d: int) -> list[tuple[int, int]]:
    return [(s, min(s + BLOCK, d)) for s in range(0, d, BLOCK)]


def _rotated(x: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(unit @ rotation(x.shape[1]), 12)


def _budget(d: int, s: int, e: int, cos: float) -> float:
    return (2 - 2 * cos) * (e - s) / d + SLACK


def coordinates(n: int, m: int) -> int:
    """How many of a block's m coordinates to grid for n vectors: the fewest rows and tests, by the shares of random
    unit vectors. A coordinate more leaves 0.32 of a cell's pairs, and the ball around a vector meets more cells."""
    cells = [sum(math.comb(g, j) * math.pi ** (j / 2) / math.gamma(j / 2 + 1) / 2**j for j in range(g + 1)) for g in range(m + 1)]
    return min(range(m + 1), key=lambda g: cells[g] * (ROW + n * 0.32**g))


def cells_of(y: np.ndarray, g: int, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, cell, home) of each row's own cell and of those that the ball of radius r around it meets.

    In cells of 2 r the ball passes at most one face in each of the g coordinates.
    """
    side = 2 * r
    own = np.floor(y[:, :g] / side).astype(np.int64)
    inside = y[:, :g] - own * side
    gap, step = np.minimum(inside, side - inside), np.where(inside < r, -1, 1)
    masks = (np.arange(1 << g)[:, None] >> np.arange(g)) & 1
    at, mask = np.nonzero((gap**2) @ masks.T <= r * r + SLACK)
    cell = own[at] + step[at] * masks[mask]
    code = np.zeros(len(at), np.uint64)
    for i in range(g):  # cells of one code share a task, no more
        code = mix64(code * np.uint64(31) + cell[:, i].view(np.uint64))
    return at, code.view(np.int64), mask == 0


def _cells(cos: float):
    """Rows (label, d, block, cell, home, point, y) of each vector's own and guest cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for d, part in pdf.groupby(pdf["v"].str.len() // 8):
                x = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), d)
                turned, size = _rotated(x), part["n"].to_numpy()
                for b, (s, e) in enumerate(_split(d)):
                    r = np.sqrt(_budget(d, s, e, cos)) + SLACK
                    grid = np.array([coordinates(int(n), e - s) for n in size])
                    for g in np.unique(grid):
                        own = np.flatnonzero(grid == g)
                        y = np.ascontiguousarray(turned[own, s:e])
                        for lo in range(0, len(own), 500):
                            at, cell, home = cells_of(y[lo : lo + 500], int(g), r)
                            at += lo
                            row = part.iloc[own[at]]
                            yield pd.DataFrame({"label": row["label"].to_numpy(), "d": d, "block": b, "cell": cell, "home": home, "point": row["point"].to_numpy(), "y": [t.tobytes() for t in y[at]]})

    return run


def _near(cos: float):
    """The rows of a tile that are within the block's budget of another one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, b = int(pdf["d"].iloc[0]), int(pdf["block"].iloc[0])
        s, e = _split(d)[b]
        y = np.frombuffer(b"".join(pdf["y"]), np.float64).reshape(len(pdf), e - s)
        own, h, g = pdf["point"].to_numpy(), np.flatnonzero(pdf["as_home"].to_numpy()), np.flatnonzero(pdf["as_guest"].to_numpy())
        sq = (y**2).sum(axis=1)
        near = (sq[h][:, None] + sq[g][None, :] - 2 * (y[h] @ y[g].T) <= _budget(d, s, e, cos) + SLACK) & (own[h][:, None] != own[g][None, :])
        hit = np.zeros(len(pdf), bool)
        hit[h[near.any(axis=1)]] = True
        hit[g[near.any(axis=0)]] = True
        return pdf.loc[hit, ["label", "d", "block", "cell", "ta", "tb", "point", "as_home", "as_guest"]]

    return run


def _tile(cos: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, b = int(pdf["d"].iloc[0]), int(pdf["block"].iloc[0])
        pdf = pdf.sort_values("rep")
        x = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), d)
        y, rep, w = _rotated(x), pdf["rep"].to_numpy(), pdf["w"].to_numpy()
        h, g = np.flatnonzero(pdf["as_home"].to_numpy()), np.flatnonzero(pdf["as_guest"].to_numpy())
        if not len(h) or not len(g):
            return pd.DataFrame({"rep": [], "links": [], "to": []}).astype("int64")
        s, e = _split(d)[b]
        yb = y[:, s:e]
        sq = (yb**2).sum(axis=1)
        near = sq[h][:, None] + sq[g][None, :] - 2 * (yb[h] @ yb[g].T) <= _budget(d, s, e, cos) + 1e-9
        i, j = np.nonzero(near)
        i, j = h[i], g[j]
        i, j = i[(ne := rep[i] != rep[j])], j[ne]
        count = np.zeros(len(pdf), np.int64)
        edges = []
        norm = np.sqrt((x * x).sum(axis=1))
        for p in range(0, len(i), 200_000):
            a, c = i[p : p + 200_000], j[p : p + 200_000]
            first = np.ones(len(a), bool)  # whether no earlier block has the pair
            for n, (s2, e2) in enumerate(_split(d)[: b + 1]):
                within = ((y[a, s2:e2] - y[c, s2:e2]) ** 2).sum(axis=1) <= _budget(d, s2, e2, cos)
                first &= within if n == b else ~within
            a, c = a[first], c[first]
            good = (x[a] * x[c]).sum(axis=1) / (norm[a] * norm[c]) >= cos
            a, c = a[good], c[good]
            np.add.at(count, a, w[c])
            edges.append((a, c))
        a, c = (np.concatenate([t[k] for t in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
        root = roots(a, c, len(pdf))  # smallest index of each local group
        seen = np.flatnonzero((count > 0) | (root != np.arange(len(pdf))))
        return pd.DataFrame({"rep": rep[seen], "links": count[seen], "to": rep[root[seen]]})

    return run


def near_vectors(vectors: DataFrame, cos: float = 0.98) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only rows of equal, non-null labels link, at a cosine of ``cos`` or more in double precision. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without a vec_id, link with nothing; their
    component is themselves. Vectors of different lengths never link. Equal vectors are one point with a weight.
    Repeated rows of a vec_id with the same vector and label are one vector. Other columns are ignored.
    """
    e = F.col("embedding").cast("array<double>")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("x"), F.col("label").cast("string").alias("label"))
    fine = F.coalesce(F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("x", lambda a: a != 0), F.lit(False))
    fit = every.where(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).distinct()

    def packed(frames):
        for p in frames:
            yield pd.DataFrame({"vec_id": p["vec_id"], "label": p["label"], "v": [(np.asarray(v, np.float64) + 0.0).tobytes() for v in p["x"]]})

    fit = stored(fit.mapInPandas(packed, "vec_id long, label string, v binary"), "vectors")
    same = stored(fit.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).withColumn("point", F.monotonically_increasing_id()), "points")
    sizes = stored(same.groupBy("label").agg(F.count("*").alias("n")), "sizes")
    cells = same.join(sized(sizes), "label").select("label", "n", "point", "v").mapInPandas(_cells(cos), "label string, d int, block int, cell long, home boolean, point long, y binary")
    cells = stored(cells, "cells")
    key = ["label", "d", "block", "cell"]
    size = stored(cells.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("home")).alias("any")).where("n > 1 and any").select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("nt")), "sizes")
    t = cells.join(sized(size), key).withColumn("t", F.pmod(F.xxhash64("point"), F.col("nt")).cast("int"))
    # a home row meets every guest tile of its cell, a guest row every home tile; the own tile comes once, as both
    kinds = F.concat(
        F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("nt") - 1), lambda o: F.struct(F.col("t").alias("ta"), o.alias("tb"), F.lit(True).alias("as_home"), (o == F.col("t")).alias("as_guest")))).otherwise(F.array()),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("nt") - 1), lambda o: (o != F.col("t")) | ~F.col("home")), lambda o: F.struct(o.alias("ta"), F.col("t").alias("tb"), F.lit(False).alias("as_home"), F.lit(True).alias("as_guest"))),
    )
    t = t.select(*key, "point", "y", F.explode(kinds).alias("k")).select(*key, "point", "y", "k.*")
    near = t.groupBy(*key, "ta", "tb").applyInPandas(_near(cos), "label string, d int, block int, cell long, ta int, tb int, point long, as_home boolean, as_guest boolean")
    near = stored(near, "near")
    drop_stored(cells)
    near = near.join(same.select("point", "rep", "w", "v"), "point")
    found = stored(near.groupBy(*key, "ta", "tb").applyInPandas(_tile(cos), "rep long, links long, to long"), "found")
    comp = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = same.select("label", "v", "rep", "w").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per = stored(per.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "result")
    linked = fit.join(per, ["label", "v"]).select("vec_id", "n_links", "component_id")
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""N-gram Jaccard join by a distributed count-vector R-tree.

Shingles are hashed into groups and a document is the point of its group counts: a sparse vector of GROUPS groups, and
its folds into fewer groups. Two sets of similarity j differ in at most D = (|A| + |B|)(1 - j) / (1 + j) shingles, so
their points are at most D apart (L1). The tree's upper level packs points by a size band and by the sub-vectors of
D + 1 + E blocks of groups: E + 1 of the blocks at least have equal counts, so points that can be within reach meet in a
leaf. A point with at most E empty blocks needs no leaf of an empty one, which all such points would share, whatever their
texts; the few points with more are also dealt into blocks anew, up to DEALS times.
Below it, a leaf's points are packed into boxes (sorted by size and counts) with the maxima of their coordinates, and
the overlap of two boxes or points is bounded by the summed minima of their coordinates. All candidates come from
this search; those that survive finer points too are verified on the exact shingle sets, from the whole texts.

Equal sets are one point, and leaves with the same members are one. A point of a group of copies need not meet all
others: in each of ROUNDS rounds the search gives, for every point, the nearest one before it in its leaf that is of
another component and within the bound. Leaves that links make whole are done. What is open then is searched for all
pairs across components, in tiles of bounded size. Crowded leaves are split before: a point goes to a node for each of its
rarest groups (here of one shingle each), for as many that two points within reach have one of them in common. Points of
a node's largest component meet the others only, not each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_stored, mix64, sized, stored
from .textops import pieces, shingle_sets

#: Groups of the indexed point (many more than a corpus has shingles, or small blocks of unlike texts would be equal), and
#: of its fold that boxes are made of.
GROUPS, COARSE = 1 << 40, 256
#: Times that a point with many empty blocks is dealt into blocks; in the last, its empty ones are leaves too.
DEALS = 4
#: Parts of the keys: one moves at a time.
PARTS = 4
KEYS = [f"keys{p}" for p in range(PARTS)]
BAND, TILE, LEAF = 1.5, 256, 16
#: Shingles for each group of the fold that all pairs of open leaves are bounded by before their sets meet.
POINT = 2
#: Times that the search gives each point one other before open leaves are searched for all pairs.
ROUNDS = 2
#: Tiles of an open leaf that is searched as it is; larger ones are split.
CROWD = 2
#: Shingles, in about, of the sample that tells which groups are frequent. It decides on costs only, not on what is found.
SAMPLE = 200_000
#: Ratio of the sizes of a class; a frequent group has a node for each two classes.
CLASS = 1.05
#: Smallest open leaves that a point brings along, for a pair to be told in the first leaf that it shares only.
FIRST = 16


def _band(n: int, ratio: float = BAND) -> tuple[int, int, int]:
    """The band of a size and its smallest and largest size."""
    t = int(math.log(n) / math.log(ratio) + 1e-12)
    while math.ceil(ratio ** (t + 1)) <= n:
        t += 1
    while math.ceil(ratio**t) > n:
        t -= 1
    return t, math.ceil(ratio**t), math.ceil(ratio ** (t + 1)) - 1


def required(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -(-(num * (a + b)) // (num + den))


@lru_cache(None)
def _blocks(low: int, high: int, num: int, den: int) -> tuple[int, int, int]:
    """For a band of these sizes the number of blocks, how many of them may be empty (E; most points have no more), and the
    deals. Where the similarity asks for as many blocks as there are shingles, most are empty, and one deal has to do."""
    reach = (high + high * den // num) * (den - num) // (den + num)
    for spread in (2, 0):
        for spare in range(1, max(1, reach) + 1):
            k = reach + 1 + spare
            empty = (1 - 1 / k) ** low
            if k * empty + spread * math.sqrt(k * empty * (1 - empty)) <= spare:
                return k, spare, DEALS
    return reach + 2, 1, 1


def block_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Leaf keys of a set: hashes of its point's block sub-vectors, for its size band and, near the border, the one below.

    A sub-vector's hash sums a hash of each group as often as the group counts, so equal counts have equal hashes. Of two
    points within reach, the one that needs fewer deals has a filled block in its last one that the other has too.
    """
    n, keys = len(s), []
    own = _band(n)
    bands = [own]
    least = -(-num * n // den)  # a partner has at least as many
    if least < own[1]:
        bands.append(_band(own[1] - 1))
    group = s & np.uint64(GROUPS - 1)
    weight = mix64(group + np.uint64(1))
    for t, low, high in bands:
        k, spare, deals = _blocks(low, high, num, den)
        for deal in range(deals):
            block = (mix64(group ^ np.uint64(0x5851F42D4C957F2D + deal)) % np.uint64(k)).astype(np.int64)
            sums = np.zeros(k, np.uint64)
            np.add.at(sums, block, weight)
            ids = np.flatnonzero(np.bincount(block, minlength=k))
            enough = k - len(ids) <= spare
            if not enough and deal == deals - 1:
                ids = np.arange(k)
            keys.append(mix64(sums[ids] + mix64(np.uint64((t << 40) + (deal << 32)) + ids.astype(np.uint64))))
            if enough:
                break
    return np.unique(np.concatenate(keys)).view(np.int64)


def in_parts(keys: np.ndarray) -> list[np.ndarray]:
    """Keys by PARTS ranges of their lowest bits."""
    part = keys & (PARTS - 1)
    return [keys[part == p] for p in range(PARTS)]


def node_keys(s: np.ndarray, groups: np.ndarray, times: np.ndarray, often: float, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the nodes that a set of a crowded leaf goes to, and its side there: 0 in nodes where all points meet, else 1
    for the class of smaller sizes and 2 for that of larger ones, which meet each other only.

    ``groups`` (sorted) occur ``times`` in a sample, others less. Two sets that overlap in t groups have one in common
    among their size - t + 1 first ones of any order; rare ones come first. One that occurs more than ``often`` has a node
    for each two classes of sizes, as t is larger for larger sets and leaves it to fewer of them.
    """
    n = len(s)
    f = np.zeros(n, np.int64)
    if len(groups):
        at = np.minimum(np.searchsorted(groups, s), len(groups) - 1)
        f = np.where(groups[at] == s, times[at], 0)
    order = np.lexsort((s, f))
    s, f = mix64(s[order]), f[order]
    least, most = -(-num * n // den), den * n // num  # sizes of the sets within reach
    first = s[: n - int(required(n, least, num, den)) + 1]
    rare = first[f[: len(first)] <= often]
    keys, sides = [rare & ~np.uint64(1)], [np.zeros(len(rare), np.int32)]
    own, size = _band(n, CLASS)[0], least
    while size <= most and len(rare) < len(first):
        w, _, high = _band(size, CLASS)
        p = n - int(required(n, size, num, den)) + 1
        common = s[:p][f[:p] > often]
        two = np.uint64((min(w, own) << 32) + max(w, own) + 1)
        keys.append((mix64(common + mix64(two[None])) & ~np.uint64(1)) | np.uint64(w != own))
        sides.append(np.full(len(common), 0 if w == own else 1 if own < w else 2, np.int32))
        size = high + 1
    return np.concatenate(keys).view(np.int64), np.concatenate(sides)


def group_counts(s: np.ndarray, per_group: float | None) -> bytes:
    """The point of a set: counts of a power of two of groups, about one for each ``per_group`` shingles (None: COARSE).

    A fixed number bounds little for long texts, whose counts are all near their mean, but boxes must be small.
    """
    g = COARSE if per_group is None else max(COARSE, 1 << max(0, int(len(s) / per_group).bit_length() - 1))
    c = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
    width = next(w for w in (1, 2, 4) if c.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + c.astype(f"<u{width}").tobytes()


def unpacked(points) -> list[np.ndarray]:
    return [np.frombuffer(p, f"<u{p[0]}", offset=1).astype(np.int64) for p in points]


def folded(c: np.ndarray, g: int) -> np.ndarray:
    """Counts in fewer groups: g divides their number."""
    return c.reshape(-1, g).sum(axis=0)


def _sketch(size: int, num: int, den: int, keyed: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            for a, b in pieces(texts):
                rows = []
                for i, s in zip(ids[a:b], shingle_sets(texts[a:b], size)):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    if keyed:
                        rows.append((i, len(s), d, group_counts(s, POINT), group_counts(s, None), *in_parts(block_keys(s, num, den) if len(s) else np.zeros(0, np.int64))))
                    else:
                        rows.append((i, d, s.tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "counts", "box", *KEYS] if keyed else ["doc_id", "digest", "shingles"])

    return run


def _both(pairs: DataFrame, by: DataFrame, *columns: str) -> DataFrame:
    """The distinct ``pairs`` (a, b) with structs x and y of both documents' ``columns``; repeated rows of ``by`` are one."""
    p, x = sized(pairs), F.struct(*columns)
    left = by.join(p, by.doc_id == p.a).select("a", "b", x.alias("x"), F.lit(None).alias("y"))
    right = by.join(p, by.doc_id == p.b).select("a", "b", F.lit(None).alias("x"), x.alias("y"))
    return left.unionByName(right).groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y"))


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the distinct stored pairs (a, b) whose finer points (one row a document) still reach the required overlap."""

    def run(frames):
        for p in frames:
            need = required(p["na"].to_numpy(), p["nb"].to_numpy(), num, den)
            ok = np.zeros(len(p), bool)
            for i, (x, y) in enumerate(zip(unpacked(p["ca"]), unpacked(p["cb"]))):
                g = min(len(x), len(y))
                ok[i] = np.minimum(folded(x, g), folded(y, g)).sum() >= need[i]
            yield p.loc[ok, ["a", "b"]]

    p = _both(pairs, points, "n_shingles", "counts").selectExpr("a", "b", "x.n_shingles na", "y.n_shingles nb", "x.counts ca", "y.counts cb")
    return stored(p.mapInPandas(run, "a long, b long"), "pairs")


def _verify(pairs: DataFrame, docs: DataFrame, points: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the distinct stored pairs (a, b) whose exact shingle sets reach the similarity. ``points``: a row a document."""
    ids = points.join(sized(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), "doc_id", "left_semi")
    ids = stored(ids.select("doc_id", "digest"), "ids")
    texts = docs.join(sized(ids.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInPandas(_sketch(size, num, den, False), "doc_id long, digest binary, shingles binary")
    sets = stored(sets.join(sized(ids), ["doc_id", "digest"], "left_semi"), "sets")

    def exact(frames):
        for q in frames:
            keep = []
            for x, y in zip(q["sa"], q["sb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield q.loc[keep, ["a", "b"]] if len(q) else q[["a", "b"]]

    q = _both(pairs, sets, "shingles").selectExpr("a", "b", "x.shingles sa", "y.shingles sb")
    out = stored(q.mapInPandas(exact, "a long, b long"), "links")
    drop_stored(sets)
    return out


def _rtree_pairs(n: np.ndarray, counts: np.ndarray, num: int, den: int):
    """Index pairs (i < j) whose summed coordinate minima reach the required overlap, by boxes of LEAF points."""
    order = np.argsort(n, kind="stable")
    n, counts = n[order], counts[order]
    starts = np.arange(0, len(n), LEAF)
    top, low = np.maximum.reduceat(counts, starts), n[starts]
    for x, s in enumerate(starts):
        e = min(s + LEAF, len(n))
        near = np.flatnonzero(np.minimum(top[x:], top[x]).sum(axis=1) >= required(low[x], low[x:], num, den)) + x
        for y in near:
            t, f = starts[y], min(starts[y] + LEAF, len(n))
            bound = np.minimum(counts[s:e, None, :], counts[None, t:f, :]).sum(axis=2)
            i, j = np.nonzero(bound >= required(n[s:e, None], n[None, t:f], num, den))
            keep = (i + s) < (j + t)
            yield order[i[keep] + s], order[j[keep] + t], bound[i[keep], j[keep]]


def _nearest(n: np.ndarray, counts: np.ndarray, comp: np.ndarray, num: int, den: int):
    """For each point the index of the nearest one before it (in the boxes' order) of another component whose bound
    reaches the required overlap, or -1: its own box is searched first, then the one before, then the rest."""
    order = np.lexsort((*counts[:, :4].T, n))
    n, counts, comp = n[order], counts[order], comp[order]
    starts = np.arange(0, len(n), LEAF)
    top, low = np.maximum.reduceat(counts, starts), n[starts]
    out = np.full(len(n), -1)
    for x, s in enumerate(starts):
        e = min(s + LEAF, len(n))
        for first, last in ((x, x + 1), (x - 1, x), (0, x - 1)):
            want = np.flatnonzero(out[s:e] < 0) + s
            if first < 0 or last <= first or not len(want):
                continue
            near = np.flatnonzero(np.minimum(top[first:last], top[x]).sum(axis=1) >= required(low[x], low[first:last], num, den)) + first
            at = np.concatenate([np.arange(starts[y], min(starts[y] + LEAF, len(n))) for y in near]) if len(near) else near
            if not len(at):
                continue
            bound = np.minimum(counts[want, None, :], counts[None, at, :]).sum(axis=2)
            ok = (bound >= required(n[want, None], n[None, at], num, den)) & (comp[want, None] != comp[None, at]) & (at[None] < want[:, None])
            best = np.where(ok, bound * len(n) + at[None], -1).argmax(axis=1)
            hit = ok.any(axis=1)
            out[want[hit]] = at[best[hit]]
    found = np.flatnonzero(out >= 0)
    return order[out[found]], order[found], np.minimum(counts[out[found]], counts[found]).sum(axis=1)


def _in_leaves(num: int, den: int, every: bool):
    """Candidates (a, b, bound) of each leaf's tile: all across components, or for each point the nearest before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            rest = pd.concat(held) if len(held) > 1 else pdf
            last = rest[["key", "ta", "tb"]].iloc[-1].tolist() if len(rest) else None
            if last is None:
                continue
            open_ = (rest["key"] == last[0]) & (rest["ta"] == last[1]) & (rest["tb"] == last[2])
            held = [rest[open_]]
            yield from _groups(rest[~open_], num, den, every)
        if held:
            yield from _groups(pd.concat(held), num, den, every)

    return run


def _shared(first: list[np.ndarray], key: int) -> np.ndarray:
    """Bit rows of points: of the leaves before ``key`` in ``first`` that several points have, those that a point has."""
    at = np.repeat(np.arange(len(first)), [len(f) for f in first])
    keys = np.concatenate(first)
    at, keys = at[keys < key], keys[keys < key]
    _, no, times = np.unique(keys, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    several = times[no] > 1
    out = np.zeros((len(first), int((times > 1).sum())), bool)
    out[at[several], column[no[several]]] = True
    return np.packbits(out, axis=1)


def _groups(rows: pd.DataFrame, num: int, den: int, every: bool):
    if not len(rows):
        return
    ids, comp, n = (rows[c].to_numpy() for c in ("doc_id", "component", "n_shingles"))
    packed = rows["box"].to_numpy()
    k = rows[["key", "ta", "tb"]].to_numpy()
    cut = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s, e in zip(cut[:-1], cut[1:]):
        if (comp[s:e] == comp[s]).all():
            continue
        counts = np.stack(unpacked(packed[s:e]))
        if every:  # a pair of one tile is told in the tile's meeting with itself
            before, t, alone = _shared(rows["first"].iloc[s:e].tolist(), k[s, 0]), rows["t"].to_numpy()[s:e], k[s, 1] == k[s, 2]
        for i, j, bound in _rtree_pairs(n[s:e], counts, num, den) if every else [_nearest(n[s:e], counts, comp[s:e], num, den)]:
            told = ((t[i] == t[j]) & (not alone)) | (before[i] & before[j]).any(axis=1) if every else np.zeros(len(i), bool)
            i, j = i + s, j + s
            ok = (comp[i] != comp[j]) & ~told
            found.append((ids[i[ok]], ids[j[ok]], bound[ok] / (n[i] + n[j])[ok]))
    if found:
        a, b, bound = (np.concatenate([f[x] for f in found]) for x in (0, 1, 2))
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "bound": bound}).drop_duplicates()


def _recurring(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (key, doc_id) sorted by key, those whose key is another row's too."""
    last, told = None, True
    for pdf in frames:
        if not len(pdf):
            continue
        k = pdf["key"].to_numpy()
        as_before = np.concatenate([[last is not None and last["key"].iloc[0] == k[0]], k[1:] == k[:-1]])
        keep = as_before | np.append(as_before[1:], False)
        if as_before[0] and not told:
            yield last
        yield pdf[keep]
        last, told = pdf.iloc[-1:], keep[-1]


def _meetings(rows: DataFrame, seed: int) -> DataFrame:
    """rows (key, m, doc_id, component, side) with their tile t, a row for each tile o that it meets.

    A leaf of more than TILE points has two parts: its largest component and the rest, or the larger and the smaller sets.
    Tiles of the first part meet those of the second only; the latter also meet each other, unless the sides differ.
    """
    many = rows.where(F.col("m") > TILE)
    of_one = many.where("side = 0").groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("x"))
    larger = many.where("side = 2").groupBy("key").agg(F.count("*").alias("n")).select("key", "n", F.lit(None).cast("long").alias("main"))
    parts = stored(of_one.select("key", "x.n", F.col("x.component").alias("main")).unionByName(larger), "parts")
    r = rows.join(sized(parts), "key", "left").where("n is null or n < m")
    na, nb = (F.ceil(c / TILE).cast("int") for c in (F.col("n"), F.col("m") - F.col("n")))
    whole, in_first = F.col("n").isNull(), (F.col("side") == 2) | (F.col("side") == 0) & (F.col("component") == F.col("main"))
    h = F.xxhash64("doc_id", F.lit(seed))
    r = r.withColumn("t", F.when(whole, 0).when(in_first, nb + F.pmod(h, na)).otherwise(F.pmod(h, nb)).cast("int"))
    start = F.when(whole | in_first | (F.col("side") == 0), 0).otherwise(nb)
    end = F.when(whole, 0).when(in_first, nb - 1).otherwise(na + nb - 1)
    return r.withColumn("o", F.explode(F.sequence(start, end)))


def _searched(rows: DataFrame, boxes: DataFrame, num: int, den: int, every: bool, seed: int) -> DataFrame:
    """Candidates (a, b, bound) from rows (key, m, doc_id, component) of open leaves, in tiles of about TILE points.

    For all pairs the tiles meet that can hold a pair to tell (see ``_meetings``), and a pair is left to an earlier leaf that
    both points name among their FIRST ones; else a point is searched for in its own tile, which a new seed changes.
    """
    if every:
        rows = rows if "side" in rows.columns else rows.withColumn("side", F.lit(0))
        first = rows.where("side = 0").groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST).alias("first"))
        boxes = boxes.join(sized(stored(rows.select("doc_id").distinct(), "ids")), "doc_id", "left_semi").join(first, "doc_id", "left")
        boxes = stored(boxes.withColumn("first", F.coalesce("first", F.array().cast("array<long>"))), "boxes")
        r = _meetings(rows, seed)
    else:
        nt = F.greatest(F.lit(1), F.ceil(F.col("m") / TILE)).cast("int")
        r = rows.withColumn("t", F.pmod(F.xxhash64("doc_id", F.lit(seed)), nt).cast("int")).withColumn("o", F.col("t"))
    r = r.select("key", "doc_id", "component", "t", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"))
    r = r.join(sized(boxes), "doc_id")
    r = r.repartition(F.col("key"), F.col("ta"), F.col("tb")).sortWithinPartitions("key", "ta", "tb", "doc_id")
    r = r.select("key", "ta", "tb", "doc_id", "component", "n_shingles", "box", *(["t", "first"] if every else []))
    return r.mapInPandas(_in_leaves(num, den, every), "a long, b long, bound double")


def _opened(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """members (key, m, doc_id) with their component, of the leaves that hold several components."""
    if comp is None:
        return members.withColumn("component", F.col("doc_id"))
    rows = stored(members.join(sized(comp).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "open")
    ends = rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    return rows.join(sized(stored(ends, "ends")), "key").select("key", "m", "doc_id", "component")


def _sets(frames: Iterator[pd.DataFrame], size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Pieces of (doc_id, shingle set) of those rows (doc_id, text, digest) whose set has the digest."""
    for pdf in frames:
        ids, texts, digests = pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["digest"].tolist()
        for a, b in pieces(texts):
            sets = zip(ids[a:b], digests[a:b], shingle_sets(texts[a:b], size))
            yield [(i, s) for i, d, s in sets if xxhash.xxh3_128_digest(s.tobytes()) == bytes(d)]


def _split(rows: DataFrame, docs: DataFrame, points: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """rows (key, m, doc_id, component) of open leaves with a side, the crowded leaves' replaced by those of open nodes.

    All crowded leaves are split at once, so that a pair does not meet in each of them. ``points``: a row a document.
    """
    rows = rows.withColumn("side", F.lit(0))
    ids = stored(rows.where(F.col("m") > CROWD * TILE).select("doc_id", "component").distinct(), "ids")
    ids = stored(points.join(sized(ids), "doc_id").select("doc_id", "component", "digest", "n_shingles"), "ids")
    total = ids.agg(F.sum("n_shingles")).first()[0]
    if not total:
        return rows
    share = min(1.0, SAMPLE / total)
    texts = docs.join(sized(ids.select("doc_id", "digest")), "doc_id").select("doc_id", "text", "digest")

    def sample(frames):
        for piece in _sets(frames, size):
            yield pd.DataFrame({"shingles": [s[:SAMPLE].tobytes() for _, s in piece]})

    def nodes(frames):
        for piece in _sets(frames, size):
            found = [node_keys(s, groups, times, often, num, den) for _, s in piece]
            if found:
                keys, sides = (np.concatenate([f[x] for f in found]) for x in (0, 1))
                yield pd.DataFrame({"key": keys, "doc_id": np.repeat([i for i, _ in piece], [len(f[0]) for f in found]), "side": sides})

    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = [np.frombuffer(r.shingles, np.uint64) for r in some.mapInPandas(sample, "shingles binary").collect()]
    groups, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *some]), return_counts=True)
    groups, times, often = groups[times > 1], times[times > 1], max(1.0, share * TILE)
    own = texts.mapInPandas(nodes, "key long, doc_id long, side int").distinct()
    own = stored(own.join(sized(ids.select("doc_id", "component")), "doc_id"), "nodes")
    ends = own.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    ends = stored(ends.where("c0 < c1 and (s1 = 0 or s0 < s1)").select("key", "m"), "ends")
    own = own.join(sized(ends), "key").select("key", "m", "doc_id", "component", "side")
    return rows.where(F.col("m") <= CROWD * TILE).unionByName(own)


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are runs without white space, A-Z lower-cased; sets are of distinct ``size``-word shingles of the whole
    text (a shorter text is one shingle; no words or null text: an empty set, linked with nothing). Documents link
    when den * |intersection| >= num * |union|. Rows without a doc_id keep a null component and link with nothing;
    repeated rows of one doc_id are one document and get equal rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, counts binary, box binary, " + ", ".join(f"{k} array<long>" for k in KEYS)
    null_ids = docs.where("doc_id is null")
    sketches = stored(docs.where("doc_id is not null").mapInPandas(_sketch(size, num, den, True), schema).withColumn("row", F.monotonically_increasing_id()), "points")
    reps = stored(sketches.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), "r.row"), "reps")

    # one row of each distinct set; of a doc_id that leads several (rows with other texts), the least
    chosen = stored(reps.groupBy("rep").agg(F.min(F.struct("digest", "row")).alias("r")).select("r.row"), "chosen")
    base = stored(sketches.join(sized(chosen), "row", "left_semi").drop("row", *KEYS), "base")
    points = stored(sketches.select("doc_id", "n_shingles", "digest"), "points")
    reps = reps.select("digest", "rep")
    # a set has a key once; keys move part by part, once each, and only those of several sets are kept
    parts = []
    for k in KEYS:
        own = sketches.select("row", "doc_id", k).join(sized(chosen), "row", "left_semi").select(F.explode(k).alias("key"), "doc_id")
        own = own.repartition(F.col("key")).sortWithinPartitions("key")
        parts.append(stored(own.mapInPandas(_recurring, "key long, doc_id long"), "keys"))
    drop_stored(sketches)
    own = reduce(DataFrame.unionByName, parts)
    # leaves with the same members are one
    leaf = own.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("h"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("s"))
    leaf = stored(leaf.groupBy("m", "h", "s").agg(F.min("key").alias("key")).select("key", "m"), "leaves")
    members = stored(own.join(sized(leaf), "key").select("key", "m", "doc_id"), "members")
    for old in (*parts, leaf, chosen):
        drop_stored(old)

    boxes = stored(base.join(sized(stored(members.select("doc_id").distinct(), "ids")), "doc_id", "left_semi").select("doc_id", "n_shingles", "box"), "boxes")

    comp, links, tried = None, None, None
    for seed in range(ROUNDS + 1):
        rows = _opened(members, comp)
        if seed == ROUNDS:
            rows = _split(rows, docs, base, size, num, den)
        two = _searched(rows, boxes, num, den, seed == ROUNDS, seed)
        # of a point's candidates the one with the greatest bound for the sizes; in the end, all
        two = two.groupBy("b").agg(F.max(F.struct("bound", "a")).alias("x")).select("x.a", "b") if seed < ROUNDS else two.select("a", "b").distinct()
        if tried is not None:
            two = two.join(sized(tried), ["a", "b"], "left_anti")
        two = stored(two, "pairs")
        if two.isEmpty():
            continue
        found = _verify(two if seed < ROUNDS else _bounded(two, base, num, den), docs, base, size, num, den)
        tried = two if tried is None else tried.unionByName(two)
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            comp = stored(components(links), "components")
    for old in (base, boxes, members):
        drop_stored(old)

    out = points.select("doc_id", "n_shingles", "digest").join(sized(reps), "digest", "left").select("doc_id", "n_shingles", "rep")
    if comp is not None:
        out = out.join(sized(comp).withColumnRenamed("node", "rep"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    if null_ids.isEmpty():
        return out
    alone = null_ids.mapInPandas(_sketch(size, num, den, True), schema).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each component of near copies; rows without an id stay.

    Of repeated rows of one doc_id, one stays.
    """
    c = jaccard_components(docs, size, num, den).where("doc_id <> component_id").select("doc_id")
    gone = stored(c.distinct(), "gone")
    with_id = docs.where("doc_id is not null").join(sized(gone), "doc_id", "left_anti")
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if not again.isEmpty():
        with_id = with_id.dropDuplicates(["doc_id"])
    return with_id.select(*docs.columns).unionByName(docs.where("doc_id is null"))

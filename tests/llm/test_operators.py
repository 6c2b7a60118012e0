"""Operators against brute force, round trips, held-out accuracy and edge cases."""

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from changeloom.llm import chat, common, decontam, embeddup, jaccard, licenses, lm, mixing, pii, quality, warc
from changeloom.llm import queries as Q
from changeloom.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, h string, key string, counts string"


def docs(spark, texts, start=0):
    rows = [(i, t, "en", "src1", 0, "x", "y", "z", "c") for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, DOC)


def plain_words(text):
    """Words of decontamination and license scans."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
EDGE = [None, "", "   \n", "one", "one two", LONG, LONG, "a b c d e f g h i j k l", "a b c d e f g h i j k l", "Licensed under the Apache License, Version 2.0."]


def edge(spark):
    d = docs(spark, EDGE)
    return d.unionByName(d.where("doc_id = 7")).unionByName(spark.createDataFrame([(None, "a b c d e f g h", None, None, None, None, None, None, None)], DOC))


@pytest.mark.parametrize("block", [1000, 7])
def test_components(spark, block, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", block)
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 160)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    root = {x: x for p in e for x in p}
    for _ in root:
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in e if a == b} - {x for a, b in e if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# personal data

def test_broadcasts_follow_counted_bytes(spark):
    df = spark.createDataFrame([(1, "ab", ["x", None], [1, 2, 3]), (None, None, None, None)], "a long, s string, t array<string>, n array<long>")
    assert [r[0] for r in df.select(common.row_bytes(df)).collect()] == [64 + 2 + 33 + 48, 64]
    kept = common.stored(df, "sized")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(common.sized(kept)) and not hinted(common.sized(kept, 210)) and hinted(common.sized(kept, 211))
    assert hinted(common.sized(kept.where("a = 7"), 0))


def plain_spans(t):
    out = []
    for k, p in enumerate(pii.PATTERNS.values()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_matches_plain_patterns(spark, sf):
    texts = [r[0] or "" for r in Q.table(spark, sf, "documents").select("text").collect()]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("a1.@+- (9_%\n,"), 60)) for _ in range(400)]
    texts += ["a@@b.co x@y.z@q.r.s ..@a.b a@b a@b.c-d", "4111 1111 1111 1111 and 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "+1 (988) 555-2485", "é@b.co \U0001f600 a@b.co"]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii_adds_consistent_mentions(spark):
    train = [f"call +1 (98{i % 10}) 555-24{i:02d} or 4111111111111111 mail a{i}@b.co host 10.0.0.{i} nr {i} year 19{i:02d} phone +1415555{i:04d} and again +1415555{i:04d} see 1999 1999" for i in range(60)]
    w = pii.train(train)
    base, every = pii.spans_of("ring +14155550123 today. later again 14155550123 please, in 1999", w)
    assert [x[1] for x in base] == [3] and [x[1] for x in every] == [3, 3]
    assert pii.spans_of("nothing 123 here 123", w) == ([], [])
    assert pii.mask(docs(spark, ["x a@b.co y", None]), w).select("text").collect() == [("x [email] y",), (None,)]


def test_distant_mentions_agree():
    n = 60
    x, w = np.zeros((n, pii.NF)), np.zeros((pii.NF + 2 * pii.L, pii.L))
    x[0, 1], x[1:, 0] = 1, 1
    w[1, 4], w[0, 0], w[pii.NF + pii.L :] = 9, 0.02, 7 * np.eye(pii.L)
    node, pot = x @ w[: pii.NF], w[pii.NF + pii.L :]
    ahead, behind = np.zeros((n, pii.L)), np.zeros((n, pii.L))  # a chain's sums are exact
    for i in range(1, n):
        ahead[i] = np.logaddexp.reduce((node[i - 1] + ahead[i - 1])[:, None] + pot, axis=0)
        j = n - 1 - i
        behind[j] = np.logaddexp.reduce((node[j + 1] + behind[j + 1])[:, None] + pot, axis=0)
    z = node + ahead + behind
    want = np.exp(z - np.logaddexp.reduce(z, axis=1)[:, None])
    assert want[-1].argmax() == 4
    assert np.abs(pii.posterior(x, [(i - 1, i, 1) for i in range(1, n)], w) - want).max() < 0.01


def test_marginals_of_small_fields():
    rng, n_l = np.random.default_rng(5), pii.L
    for n, loop in itertools.product((1, 2, 4, 5), (False, True)):
        x, w = rng.normal(size=(n, pii.NF)), rng.normal(size=(pii.NF + 2 * pii.L, pii.L)) * 0.3
        for k in range(2):
            b = w[pii.NF + k * n_l : pii.NF + (k + 1) * n_l]
            b[:] = (b + b.T) / 2
        edges = [(int(rng.integers(0, i)), i, int(rng.integers(0, 2))) for i in range(1, n)]
        if loop and n > 2:
            edges += [(0, n - 1, 1), (0, n - 2, 0)]
        node, sums = x @ w[: pii.NF], np.zeros((n, n_l))
        for y in itertools.product(range(n_l), repeat=n):
            z = sum(node[i, y[i]] for i in range(n)) + sum(w[pii.NF + k * n_l + y[i], y[j]] for i, j, k in edges)
            for i in range(n):
                sums[i, y[i]] += np.exp(z)
        off = np.abs(pii.posterior(x, edges, w) - sums / sums.sum(axis=1, keepdims=True)).max()
        assert off < (0.05 if loop else 0.005), (n, loop, off)  # exact on trees, near with loops


def test_pii_trains_on_long_texts(spark):
    long = "ring +14155550123 today and in 1999. " + "word " * 5000
    assert np.abs(pii.fit(docs(spark, [long]))).max() > 0
    few = pii.fit(docs(spark, [long, "in 2001 call +493012345678", "x a@b.co 17"]), fit_bytes=60)
    assert np.abs(few).max() > 0
    with pytest.warns(UserWarning, match="to train on"):
        assert not pii.fit(docs(spark, ["none", None])).any()


def test_pii_edges(spark):
    out = pii.find_pii(edge(spark), np.zeros((pii.NF + 2 * pii.L, pii.L))).collect()
    assert len(out) == len(EDGE) + 2 and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out)
    assert pii.find_pii(docs(spark, []).limit(0)).count() == 0


# quality

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op2_quality_nbsvm(spark, sf)
    r = out.join(Q.table(spark, sf, "labels"), "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert sum(x.quality == x.predicted for x in r) / len(r) > 0.95
    good, bad = [x.score for x in r if x.quality], [x.score for x in r if not x.quality]
    assert np.mean([g > b for g, b in itertools.product(good, bad)]) > 0.95


def test_dual_descent_against_projected_gradients():
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(90)]
    scale, cost = rng.normal(size=40), rng.uniform(0.5, 2, 90)
    x = np.zeros((90, 41))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt(len(r))
    x[:, 40] = 1.0  # the bias
    y = np.where(x @ rng.normal(size=41) + rng.normal(size=90) > 0.5, 1.0, -1.0)
    assert 10 < (y > 0).sum() < 80
    loss = lambda w: w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w))
    q = (y[:, None] * x) @ (y[:, None] * x).T
    a, step = np.zeros(90), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(30_000):
        a = np.clip(a - step * (q @ a - 1), 0, cost)
    want = x.T @ (a * y)
    assert loss(want) - (a.sum() - a @ q @ a / 2) < 1e-3  # no gap: this is the minimum
    w, bias = quality._descend(rows, scale, y, cost, 5000)
    got = np.append(w, bias)
    assert loss(got) < loss(want) * 1.005 and np.abs(got - want).max() < 0.05


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = quality.fit(docs(spark, ["a"]), none)
    out = quality.score(edge(spark), m).collect()
    assert len(out) == len(EDGE) + 2 and all(0 <= r.score <= 1 for r in out)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 5), (3, None), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int")
    assert quality.score(edge(spark), quality.fit(edge(spark), labels)).count() == len(EDGE) + 2


# embeddings

def test_vectors_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        base = rng.standard_normal(20)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), [float(v) for v in (base + rng.standard_normal(20) * rng.uniform(0, 0.25)) * rng.uniform(0.1, 9)], int(c % 3)))
    rows += [(len(rows) + i, list(rows[i][1]), rows[i][2]) for i in range(5)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 20, 1), (n + 3, [float("nan")] * 20, 1), (n + 4, [None, 1.0], 1), (n + 5, [1.0] * 20, None), (n + 6, [float("inf")] * 20, 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    got = {r.vec_id: r for r in embeddup.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows])
    lab = np.array([r[2] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab) & ~np.eye(n, dtype=bool)
    comp = np.arange(n)
    for _ in range(n):
        comp = np.minimum(comp, np.where(link, comp[None, :], n).min(axis=1))
    assert link.sum() > 40
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(n, n + 7)) and len(got) == n + 8
    assert embeddup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("grid", [1, 4, 8])
def test_vectors_tiles(spark, grid, monkeypatch):
    monkeypatch.setattr(embeddup, "TILE", 7)
    monkeypatch.setattr(embeddup, "coordinates", lambda n, m: min(grid, m))
    test_vectors_brute_force(spark)


def test_cells_prune(spark):
    """Random unit vectors: the pairs that meet in a cell of a block, of all, and the rows of a vector in a block."""
    x = np.random.default_rng(2).standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, r = x @ embeddup.rotation(64), np.sqrt(embeddup._budget(64, 0, 8, 0.98))
    met, rows = {}, {}
    for g in (2, 4, 8):
        at, cells, home = embeddup.cells_of(y[:, :8], g, r)
        homes, guests = np.bincount(np.unique(cells, return_inverse=True)[1], home), np.bincount(np.unique(cells, return_inverse=True)[1])
        met[g], rows[g] = (homes * guests).sum() / len(x) ** 2, len(at) / len(x)
    assert met[2] > met[4] > met[8] and met[4] < 0.25 and met[8] < 0.03 and rows[8] < 150
    assert embeddup.coordinates(10, 8) == 0 and embeddup.coordinates(10**9, 8) == 8 and embeddup.coordinates(10**9, 3) == 3


# n-gram Jaccard join

@pytest.mark.parametrize("size,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_brute_force(spark, size, num, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 6)
    rng = np.random.default_rng(size)
    texts = []
    for _ in range(25):
        words = [f"v{x}" for x in rng.integers(0, 300, int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 7))):
            w = list(words)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"v{rng.integers(0, 300)}"
            texts.append(" ".join(w[int(rng.integers(0, 3)):]))
    texts += EDGE
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r for r in jaccard.jaccard_components(docs(spark, texts), size, num, 100).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(sets))] == [(len(s), root[i]) for i, s in enumerate(sets)]


def test_jaccard_edges(spark):
    out = jaccard.jaccard_components(edge(spark)).collect()
    assert len(out) == len(EDGE) + 2 and sum(r.component_id is None for r in out) == 1
    assert jaccard.jaccard_components(docs(spark, []).limit(0)).count() == 0
    kept = sorted(r.doc_id for r in jaccard.keep_one(edge(spark)).where("doc_id is not null").collect())
    assert kept == [0, 1, 2, 3, 4, 5, 7, 9]


@pytest.mark.parametrize("num", [90, 80, 50])
def test_jaccard_keys_of_sets_within_reach_meet(num):
    rng = np.random.default_rng(num)
    for n in [*range(1, 60), *rng.integers(60, 900, 120)]:
        m = int(rng.integers(n, min(n * 100 // num, n * 149 // 100) + 1))
        both = min(n, jaccard.required(n, m, num, 100))
        h = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        a, b = (jaccard.block_keys(np.unique(x), num, 100) for x in (h[:n], h[n - both :]))
        assert len(np.intersect1d(a, b)), (n, m)


def test_jaccard_unlike_texts_share_no_leaves():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(80, 500)), dtype=np.uint64)) for _ in range(3000)]
    met = np.unique(np.concatenate([jaccard.block_keys(s, 80, 100) for s in sets]), return_counts=True)[1]
    assert (met * (met - 1) // 2).sum() < 30


@pytest.mark.parametrize("batch", [1, 2, 3, 50])
def test_jaccard_recurring_keys(batch):
    keys = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6]
    rows = pd.DataFrame({"key": keys, "doc_id": range(10)})
    got = pd.concat(jaccard._recurring(rows[i : i + batch] for i in range(0, 10, batch)))
    assert got.doc_id.tolist() == [1, 2, 4, 5, 6, 8, 9] and all(keys[d] == k for k, d in zip(got.key, got.doc_id))


@pytest.mark.parametrize("tile", [256, 5])
def test_jaccard_pairs_are_told_once(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.05, rng.integers(0, 1 << 63, 300, dtype=np.uint64), base)) for _ in range(24)]
    boxes = spark.createDataFrame([(i, len(x), bytearray(jaccard.group_counts(x, None))) for i, x in enumerate(sets)], "doc_id long, n_shingles long, box binary")
    keys = pd.DataFrame([(int(k), i, i) for i, x in enumerate(sets) for k in jaccard.block_keys(x, 80, 100)], columns=["key", "doc_id", "component"])
    keys["m"] = keys.groupby("key").doc_id.transform("count")
    rows = spark.createDataFrame(keys[keys.m > 1], "key long, doc_id long, component long, m long")
    got = [(r.a, r.b) for r in jaccard._searched(rows, boxes, 80, 100, True, 2).collect()]
    linked = {(a, b) for a, b in itertools.combinations(range(24), 2) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - c)}
    assert len(linked) > 100 and linked <= set(got) and len(got) < 1.5 * len(set(got))


@pytest.mark.parametrize("num", [90, 80, 50])
def test_jaccard_nodes_of_sets_within_reach_meet(num):
    rng = np.random.default_rng(num)
    for n in [*range(1, 40), *rng.integers(40, 900, 80)]:
        m = int(rng.integers(n, n * 100 // num + 1))
        both = min(n, jaccard.required(n, m, num, 100))
        h = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        groups = np.unique(h[rng.random(len(h)) < rng.random()])
        times = rng.integers(2, 9, len(groups))
        met = [{(k, s) for k, s in zip(*jaccard.node_keys(np.unique(x), groups, times, 4, num, 100))} for x in (h[:n], h[n - both :])]
        assert any((k, {0: 0, 1: 2}.get(s)) in met[1] for k, s in met[0]), (n, m)


def test_jaccard_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    search, in_leaves, made = jaccard._searched, jaccard._in_leaves, []

    def count(frames):
        for f in frames:
            yield pd.DataFrame({"a": [len(f)], "b": [0], "bound": [0.0]})

    def counted(rows, boxes, num, den, every, seed):
        if every:
            monkeypatch.setattr(jaccard, "_in_leaves", lambda *_: count)
            made.append(search(rows, boxes, num, den, every, seed).agg(F.sum("a")).first()[0])
            monkeypatch.setattr(jaccard, "_in_leaves", in_leaves)
        return search(rows, boxes, num, den, every, seed)

    monkeypatch.setattr(jaccard, "_searched", counted)
    rng = np.random.default_rng(9)
    texts = []
    for i in range(360):  # one edit links with most, three with few or none; some lack their start
        w = [f"b{x}" for x in range(70)]
        for j in rng.choice(70, 1 if i % 3 == 0 else 3, replace=False):
            w[j] = f"e{i}x{j}" if i % 10 else f"e{j}"
        texts.append(" ".join(w[int(rng.integers(0, 9)) * (i % 4 == 0) :]))
    for n in (180, 360):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(spark, texts[:n]), 5, 80, 100).collect()}
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts[:n])]
        root = np.arange(n)
        links = [(a, b) for a, b in itertools.combinations(range(n), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        root = common.roots(*np.array(links).T, n)
        assert [got[i] for i in range(n)] == root.tolist() and 40 < len(set(root)) < n - 40
    assert made[1] < 3 * made[0], made


# decontamination

def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "b c d e f g h i"), (2, "ONE"), (10, "zz a b c d e f g h"), (3, None), (None, "a b c d e f g h"), (4, "!!"), (1, "b c d e f g h i")], "item_id long, text string")
    got = decontam.decontaminate(edge(spark).withColumn("n_hit", F.lit("clash")), items).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) + 2
    assert (by[7].n_words, by[7].n_hit, by[7].n_items, by[7].contaminated) == (12, 9, 2, True)
    assert by[7].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert (by[3].n_hit, by[3].n_items) == (1, 1) and by[4].n_hit == 1 and by[0].n_words == 0 and by[5].n_hit == 0
    assert by[None].n_hit == 8 and by[None].n_items == 1
    assert decontam.decontaminate(edge(spark), items.limit(0)).where("n_items > 0").count() == 0
    assert decontam.decontaminate(docs(spark, []).limit(0), items).count() == 0


# licenses

def test_short_license_lines_are_never_lost(spark):
    line = {0: "Released under the MIT License.", 1: "Licensed under CC BY-NC 4.0.", 2: "Licensed under CC BY 4.0."}
    texts = [" ".join([*(f"a{i}x{k}" for k in range(5 + i % 7)), line[i % 3], *(f"b{i}x{k}" for k in range(9))]) for i in range(30_000)]
    t = spark.createDataFrame(licenses.TEMPLATES, "template_id string, text string")
    out = licenses.scan_licenses(docs(spark, texts).select("doc_id", "text"), t)
    names = {0: "MIT", 1: "CC-BY-NC-4.0", 2: "CC-BY-4.0"}
    assert [(r.doc_id, r.licenses) for r in out.collect() if r.licenses != names[r.doc_id % 3]] == []


def test_edited_notices_are_found(spark):
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    texts, want = [], []
    for name, text in licenses.TEMPLATES:
        ws, own = text.split(), grams(plain_words(text))
        for i in range(len(ws)):
            t = " ".join([f"lead{i}", "in", *ws[:i], "zzq", *ws[i + 1 :], "tail", f"out{i}"])
            if len(own & grams(plain_words(t))) >= licenses.CONTAINED * len(own):
                texts.append(t)
                want.append(name)
    assert len(texts) > 80
    t = spark.createDataFrame(licenses.TEMPLATES, "template_id string, text string")
    got = {r.doc_id: r.licenses.split(",") for r in licenses.scan_licenses(docs(spark, texts), t).collect()}
    assert [i for i, name in enumerate(want) if name not in got[i]] == []


def test_license_edges(spark):
    t = spark.createDataFrame([*licenses.TEMPLATES, (None, "a b c d e f"), ("short", "a b"), ("null", None)], "template_id string, text string")
    for name, text in licenses.TEMPLATES:
        texts = [f"{'pad word ' * k}{text} more pad words here" for k in range(6)]
        assert all(name in r.licenses.split(",") for r in licenses.scan_licenses(docs(spark, texts), t).collect()), name
    out = {r.doc_id: r.licenses for r in licenses.scan_licenses(edge(spark), t).collect()}
    assert out[9] == "Apache-2.0" and not any(v for k, v in out.items() if k != 9)
    assert licenses.scan_licenses(docs(spark, []).limit(0), t).count() == 0
    assert licenses.scan_licenses(edge(spark), t.limit(0)).where("n_licenses > 0").count() == 0


# language model

def test_lm_edges_and_trigrams(spark):
    out = {r.doc_id: r for r in lm.stupid_backoff(edge(spark), 2).collect()}
    assert (out[0].n_tokens, out[0].log_score, out[0].mean_log_score) == (0, 0.0, None) and out[5].n_backoff == 0
    assert lm.stupid_backoff(docs(spark, []).limit(0)).count() == 0
    three = {r.doc_id: r for r in lm.stupid_backoff(docs(spark, ["a b c", "a b c", "a b d"]), 3).collect()}
    # a: 2/6; b after a: 2/2 at the second order (of three, at the text's start); c after a b: 1/2
    assert three[0].log_score == pytest.approx(np.log(2 / 6) + np.log(1.0) + np.log(1 / 2))


def plain_backoff(texts, order, alpha=0.4):
    import collections

    words = [(t or "").lower().split() for t in texts]
    grams = [collections.Counter(tuple(w[i : i + o]) for o in range(1, order + 1) for i in range(len(w) - o + 1)) for w in words]
    every, total = sum(grams, collections.Counter()), sum(map(len, words))
    out = []
    for w, own in zip(words, grams):
        f, others, s = (lambda g: every[g] - own[g]), total - len(w), 0.0  # noqa: B023
        for i in range(len(w)):
            most = min(i + 1, order)
            for o in range(most, 0, -1):
                g = tuple(w[i - o + 1 : i + 1])
                if o == 1:
                    p = f(g) / others if f(g) else 1 / (others + 1)
                elif f(g):
                    p = f(g) / f(g[:-1])
                else:
                    continue
                s += np.log(p * alpha ** (most - o))
                break
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("order,flat", [(1, 4096), (3, 4096), (3, 0), (4, 0)])
def test_lm_brute_force(spark, order, flat, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 400)  # several chunks and ranges, in one level and in two
    monkeypatch.setattr(lm, "FLAT", flat)
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.6, int(rng.integers(0, 60))) if x < 30) for _ in range(80)] + ["the of the of " * 30] * 9 + [None, "", "w1"]
    got = {r.doc_id: r for r in lm.stupid_backoff(docs(spark, texts), order).collect()}
    for i, (n, s) in enumerate(plain_backoff(texts, order)):
        assert got[i].n_tokens == n and got[i].log_score == pytest.approx(s, abs=1e-8), i


def test_lm_spread():
    assert [lm.spread(p) for p in (1, 2, 16, 17, 10_000)] == [1, 2, 4, 5, 100]


# chat

def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nAlso, what is a heap?"), (1, 1, "assistant", "Use a comparison sort."), (1, 2, "user", "> How do I sort?\nIn what language?"),
        (1, 3, "user", "On Monday, B wrote:\n> > How do I sort?\n> In what LANGUAGE?\nPython."), (1, 4, "assistant", "> never said\nok"), (2, 7, "user", None), (2, 7, "user", None),
        (3, 5, "user", "> quote of nothing"), (None, 0, "user", "> x\ny"), (4, None, None, "z"), (1, 5, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h", F.lit("clash"))
    out = chat.link_quotes(df)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert out.count() == len(rows) - 1
    assert (got[1, 2].text, got[1, 2].parent_turn, got[1, 2].n_linked) == ("In what language?", 0, 1)
    assert (got[1, 3].text, got[1, 3].parent_turn, got[1, 3].max_level, got[1, 3].n_linked) == ("Python.", 2, 2, 2)
    assert (got[1, 4].parent_turn, got[1, 4].n_quoted, got[1, 4].n_linked) == (3, 1, 0)
    assert [got[1, t].depth for t in range(6)] == [0, 1, 1, 2, 3, 4] and all(got[1, t].root_turn == 0 for t in range(6))
    assert (got[2, 7].text, got[3, 5].text, got[3, 5].root_turn, got[None, 0].text) == ("", "", 5, "y")
    pieces = chat.chat_pieces(out).where("conv_id = 1").collect()
    assert [m.turn for m in pieces[0].messages] == [0, 1, 2, 3, 4]
    assert chat.link_quotes(df.limit(0)).count() == 0


def test_quotes_of_other_line_breaks(spark):
    para = "The heap keeps its least entry at the root, and every push or pop moves entries along one path only. Paths have the length of a logarithm."
    rows = [
        (1, 0, "user", para + "\nThanks."), (1, 1, "user", "Use a sort. It is stable! And red-black trees are slower."), (1, 2, "user", "Nothing here."),
        (1, 3, "user", "> The heap keeps its least entry at the root,\n> and every push or pop moves entries\n> along one path only. Paths have\n> the length of a logarithm. Thanks.\nre-wrapped"),
        (1, 4, "user", "> It is stable!\none sentence"), (1, 5, "user", "> red-black\n> trees\nshort"), (1, 6, "user", "> every push or pop moves ENTRIES\n>\n> made up\npart of a line"),
        (1, 7, "user", ">> along one path\n> short\n> but\nlevels"), (1, 8, "user", "> push or pop moves entries along another path\n> It is stab\nnot whole words"),
        (2, 0, "user", "elsewhere"), (2, 1, "user", "> It is stable!\nother conversation"), (2, 2, "user", "> words that come later on\nx"), (2, 3, "user", "these words that come later on"),
        (3, 0, "user", "one\ntwo"), (3, 1, "user", "> one two\n> one two\njoined"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_quoted, r.n_linked) for r in chat.link_quotes(df).collect()}
    assert [got[1, t] for t in range(3, 9)] == [(0, 4, 4), (1, 1, 1), (1, 2, 2), (0, 2, 1), (5, 3, 2), (7, 2, 0)]
    assert (got[2, 1], got[2, 2], got[3, 1]) == ((0, 1, 0), (1, 1, 0), (0, 2, 0))


def test_quotes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    said, rows = [], []
    for t in range(60):
        own = " ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(1, 14)))
        quote = ""
        if t and rng.random() < 0.7:
            src = said[rng.integers(0, t)].split()
            a = rng.integers(0, len(src))
            part = src[a : a + int(rng.integers(1, 9))] + ["w9"] * int(rng.random() < 0.2)
            quote = "> " + "".join(w + ("\n> " if i + 1 < len(part) and rng.random() < 0.3 else " ") for i, w in enumerate(part)) + "\n"
        said.append(own)
        rows.append((1, t, "user", quote + own))
    got = {r.turn: r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for _, t, _, text in rows:
        lines = [x[2:].strip() for x in text.split("\n") if x.startswith("> ")]
        whole = " ".join(lines)
        at = {}  # the latest that owns a line, or holds the passage
        for x in lines:
            for s in [max((s for s in range(t) if said[s] == x), default=None), max((s for s in range(t) if f" {whole} " in f" {said[s]} "), default=None)]:
                if s is not None:
                    at.setdefault(s, set()).add(x)
        best = max(((len(v), s) for s, v in at.items()), default=None)
        assert got[t].parent_turn == (best[1] if best else t - 1 if t else None), (t, text)


def test_a_common_line_gives_one_link_a_quote(spark, monkeypatch):
    n, kept = 3000, {}
    put = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, name: kept.setdefault(name, put(df, name)) if name == "links" else put(df, name))
    rows = [(1, t, "user", "> ok\nok" if t else "ok") for t in range(n)]
    got = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert kept["links"].count() == n - 1
    assert all((r.parent_turn, r.n_linked) == (r.turn - 1 if r.turn else None, int(r.turn > 0)) for r in got)


def test_turns_with_gaps(spark):
    rows = [(c, t, "user", f"text {c} {t}") for c, ts in ((1, (0, 2, 5)), (2, (10,)), (3, range(0, 4000, 10))) for t in ts] + [(1, 5, "user", "another")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in chat.link_quotes(df).collect()}
    assert [got[1, t] for t in (0, 2, 5)] == [(None, 0, 0), (0, 0, 1), (2, 0, 2)] and got[2, 10] == (None, 10, 0)
    assert all(got[3, t] == (t - 10 if t else None, 0, t // 10) for t in range(0, 4000, 10))


def test_query_builds_conversations(spark, tmp_path):
    rows = [(1, 300, "user", "> first\nfourth"), (1, 2, "user", "> first"), (1, 0, "user", "first"), (1, 1, "assistant", "> first\nsecond"), (2, 4, "user", "other")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = Q.queries()["op7_quotation_linking"](spark, str(tmp_path)).orderBy("conv_id", "root_turn", "piece", "position").collect()
    assert [(r.conv_id, r.root_turn, r.piece, r.position, r.turn, r.content, r.parent_turn, r.depth) for r in got] == [
        (1, 0, 0, 0, 0, "first", None, 0), (1, 0, 0, 1, 1, "second", 0, 1), (1, 0, 1, 0, 300, "fourth", 0, 1), (2, 4, 0, 0, 4, "other", None, 0),
    ]


# mixing

def test_budgets():
    assert mixing.split_budget(100, [1, 1], [200, 10]) == [90, 10]
    assert mixing.split_budget(100, [3, 1], [200, 200]) == [75, 25]
    assert mixing.split_budget(100, [1, 1], [20, 10]) == [20, 10]
    supply = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 1000}
    # the shortage of x goes to its sibling y first
    assert mixing.leaf_budgets(supply, 100.0, {}, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.leaf_budgets(supply, 400.0, {}, 1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 290}


def plain_budgets(supply, budget, weights, epochs, path=()):
    """Shares of each node's children are min(cap, level * weight), at the level at which they hold the node's share."""
    if path in supply:
        return {path: int(budget + 1e-6)}
    children = sorted({k[: len(path) + 1] for k in supply if k[: len(path)] == path}, key=str)
    ws = [weights.get(c, 1.0) for c in children]
    caps = [epochs * sum(n for k, n in supply.items() if k[: len(c)] == c) for c in children]
    budget, low, high = min(budget, sum(c for c, w in zip(caps, ws) if w > 0)), 0.0, 1e9
    for _ in range(150):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for c, w in zip(caps, ws)) < budget else (low, mid)
    return {k: v for c, w, cap in zip(children, ws, caps) for k, v in plain_budgets(supply, min(cap, high * w), weights, epochs, c).items()}


def check_mix(before, out, weights, share, epochs):
    """Leaves get prefixes of their budgets; before: (doc_id, leaf, words), out: (doc_id, leaf, epoch, n_tokens)."""
    leaves = {}
    for i, leaf, n in before:
        if n:
            leaves.setdefault(leaf, {})[i] = n
    goal = plain_budgets({k: sum(v.values()) for k, v in leaves.items()}, share * sum(sum(v.values()) for v in leaves.values()), weights, epochs)
    assert {leaf for _, leaf, _, _ in out} <= set(leaves)
    for leaf, own in leaves.items():
        rows = [r for r in out if r[1] == leaf]
        assert all(own[r[0]] == r[3] for r in rows) and len({(r[0], r[2]) for r in rows}) == len(rows)
        total, left, top = sum(r[3] for r in rows), goal[leaf], max((r[2] for r in rows), default=0)
        most = max((r[3] for r in rows if r[2] == top), default=0)  # the last of the prefix is one of these
        assert total - most < left <= total if rows else left == 0, leaf
        assert all({r[0] for r in rows if r[2] == e} == set(own) for e in range(top))


def test_budgets_of_random_trees():
    rng = np.random.default_rng(9)
    for _ in range(60):
        paths = {(f"d{rng.integers(3)}", f"l{rng.integers(3)}", f"s{rng.integers(4)}") for _ in range(14)}
        supply = {p: int(rng.integers(1, 2000)) for p in paths}
        weights = {p[: rng.integers(1, 4)]: float(rng.choice([0, 0.5, 2, 7])) for p in list(paths)[:8]}
        budget, epochs = float(rng.integers(1, 30_000)), int(rng.integers(1, 4))
        got, want = mixing.leaf_budgets(supply, budget, weights, epochs), plain_budgets(supply, budget, weights, epochs)
        assert set(want) == paths and all(abs(got.get(p, 0) - want[p]) <= 1 for p in paths)


def test_mix_prefixes(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    d = Q.with_domain(Q.table(spark, sf, "documents"))
    out = mixing.mix(d, Q.WEIGHTS, share=0.8).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "rank_hash").collect()
    every = d.select("doc_id", "domain", "lang", "source", "text").collect()
    leaves = {}
    for r in every:
        if n := len((r.text or "").split()):
            leaves.setdefault((r.domain, r.lang, r.source), {})[r.doc_id] = n
    goal = plain_budgets({k: sum(v.values()) for k, v in leaves.items()}, 0.8 * sum(sum(v.values()) for v in leaves.values()), Q.WEIGHTS, 3)
    for leaf, own in leaves.items():
        rows = [r for r in out if (r.domain, r.lang, r.source) == leaf]
        total, left = sum(r.n_tokens for r in rows), goal.get(leaf, 0)
        last = max(rows, key=lambda r: (r.epoch, r.rank_hash)).n_tokens if rows else 0
        assert total - last < left <= total if rows else left == 0, leaf
        assert all({r.doc_id for r in rows if r.epoch == e} == set(own) for e in range(max((r.epoch for r in rows), default=0)))
    again = mixing.mix(d.repartition(5), Q.WEIGHTS, share=0.8).select("doc_id", "epoch").collect()
    assert sorted((r.doc_id, r.epoch) for r in out) == sorted(again)


def test_mix_edges(spark):
    d = Q.with_domain(edge(spark))
    out = mixing.mix(d, {}, share=1.0).collect()
    assert sum(r.n_tokens for r in out) > 0 and all(r.text for r in out)
    assert mixing.mix(d.limit(0), {}).count() == 0


# archives

def test_archives_round_trip(spark, tmp_path):
    html = ["<p>é</p>", None, "", "x\r\n\r\nWARC/1.1\r\n" * 4000, "<p>é</p>", "0\r\n\r\n", "y" * 100_000, None]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", h) for i, h in enumerate(html)] + [(None, None, "n"), (6, "u", "y" * 100_000)], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(html) + 2
    first = {}
    for i, h in enumerate(html):
        b = (h or "").encode()
        lead = first.setdefault(b, i)
        r = next(r for r in got if r.page_id == i)
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
    path = str(tmp_path / "w")
    warc.write_archives(pages.where("page_id = 6").limit(1), path)
    whole = warc.read_archives(spark, path).collect()
    assert len(whole) == 1 and bytes(whole[0].payload).decode() == "y" * 100_000 and whole[0].problem is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_characters_over_segment_borders(spark, tmp_path):
    html = ["é\u20ac\U0001f600" * 40 + "x" * k for k in range(4)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string"), path, segment_bytes=37)
    got = {r.record_id.split(":")[2]: r for r in warc.read_archives(spark, path).collect()}
    assert all(bytes(got[str(i)].payload).decode() == h and got[str(i)].problem is None for i, h in enumerate(html))


def test_archives_with_faults(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 10)
    seg = lambda i, n, part, total=None: warc._record("response" if i == 1 else "continuation", f"urn:{n}" if i == 1 else f"urn:{n}:{i}", part, [("WARC-Segment-Number", str(i)), *([("WARC-Segment-Origin-ID", f"<urn:{n}>")] if i > 1 else []), *([("WARC-Segment-Total-Length", str(total))] if total else [])]) + b"\r\n\r\n"
    data = seg(2, "a", block[30:], len(block)) + seg(1, "a", block[:30]) + seg(1, "b", block[:30]) + seg(1, "c", block[:30]) + seg(2, "c", block[30:], 7) + seg(2, "d", block[30:], len(block))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.warc").write_bytes(data)
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "f")).collect()}
    assert bytes(got["urn:a"].payload) == b"abc" * 10 and got["urn:a"].problem is None
    assert [got[f"urn:{x}"].problem for x in "bcd"] == ["missing segment", "total length", "missing segment"]
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


# pipeline

def plain_kept(rows):
    """Ids of one row of each group of near copies: five-word shingles, linked pair by pair."""
    sets = {}
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
            i, j = sorted((top(i), top(j)))
            root[j] = i
    return {i for i in sets if root[i] == i}


def plain_clean(rows, items):
    runs = {}
    for r in items:
        ws = plain_words(r.text)
        n = min(8, len(ws))
        if n and r.item_id is not None:
            runs.setdefault(n, set()).update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    words = {r.doc_id: plain_words(r.text) for r in rows}
    return {d for d, ws in words.items() if not any(tuple(ws[i : i + n]) in s for n, s in runs.items() for i in range(len(ws) - n + 1))}


def test_pipeline_stages(spark, sf, monkeypatch):
    import corpus_pipeline as P

    seen = {}

    def noted(module):
        fit = module.fit

        def run(*a, **k):
            seen[module] = (a, fit(*a, **k))
            return seen[module][1]

        return run

    for module in (quality, pii):
        monkeypatch.setattr(module, "fit", noted(module))
    items = Q.table(spark, sf, "benchmark").collect()
    d = Q.table(spark, sf, "documents")
    columns, rows = d.columns, {}
    before = d.collect()
    for name, stage in P.STAGES:
        d = stage(spark, d, sf).cache()
        assert name == "mixing" or d.columns == columns
        after = d.collect()
        rows[name], before = (before, after), after
    ids = lambda rs: sorted(r.doc_id for r in rs)

    before, after = rows["quality"]
    (_, labels), model = seen[quality]
    learnt = [r.doc_id for r in labels.collect()]
    assert learnt and all(zlib.crc32(str(i).encode()) % 5 for i in learnt)
    assert ids(after) == sorted(r.doc_id for r in before if model.scores([r.text])[0] >= 0.3)
    for name, want in (("near_copies", plain_kept), ("decontamination", lambda rs: plain_clean(rs, items))):
        before, after = rows[name]
        assert ids(after) == sorted(want(before)), name
        assert set(after) <= set(before) and len(after) < len(before), name

    before, after = rows["personal_data"]
    texts, n_spans = {r.doc_id: r for r in after}, 0
    assert ids(before) == ids(after)
    for r in before:
        t, every = r.text or "", pii.spans_of(r.text, seen[pii][1])[1]
        assert set(plain_spans(t)) <= set(every)
        n_spans += len(every)
        gone = {i for s, _, e in every for i in range(s, e)}
        rest = "".join(c for i, c in enumerate(t) if i not in gone)
        new = texts[r.doc_id]
        assert re.sub(r"\[(email|ip|card|phone)\]", "", new.text or "") == rest and len(re.findall(r"\[(?:email|ip|card|phone)\]", new.text or "")) <= len(every)
        assert (new.text is None) == (r.text is None) and new.n_chars == (None if r.text is None else len(new.text)) and (new.lang, new.source) == (r.lang, r.source)
    assert n_spans > 0

    before, after = rows["mixing"]
    domain = lambda r: f"d{int(m[0]) % 4 if (m := re.search('[0-9]+$', r.source or '')) else 0}"
    check_mix([(r.doc_id, (domain(r), r.lang, r.source), len((r.text or "").split())) for r in before], [(r.doc_id, (r.domain, r.lang, r.source), r.epoch, r.n_tokens) for r in after], Q.WEIGHTS, 0.5, 3)
    empty = Q.table(spark, sf, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0


# names of other columns

CLASH = ["ids", "x_ids", "h_id", "h_th", "x_hit", "x_th", "x0", "Y1", "c_o", "c_d", "x_d", "leaf", "goal", "d", "t", "o", "l_id", "y", "epoch_", "a", "b", "key", "rep", "component", "node", "words", "p", "th"]


def test_other_columns_may_have_any_name(spark, sf):
    import corpus_pipeline as P

    d = Q.table(spark, sf, "documents")
    wide = d.withColumns({c: F.lit("v") for c in CLASH})
    bench = Q.table(spark, sf, "benchmark")
    same = lambda a, b, key: sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))
    assert same(decontam.decontaminate(wide, bench), decontam.decontaminate(d, bench), ["doc_id", "n_hit", "n_items", "items_sha256"])
    assert set(wide.columns) < set(decontam.decontaminate(wide, bench).columns)
    assert same(mixing.mix(Q.with_domain(wide), Q.WEIGHTS), mixing.mix(Q.with_domain(d), Q.WEIGHTS), ["doc_id", "epoch", "n_tokens"])
    assert set(wide.columns) < set(mixing.mix(Q.with_domain(wide), Q.WEIGHTS).columns)
    for name, stage in P.STAGES:
        got, want = stage(spark, wide, sf), stage(spark, d, sf)
        assert same(got, want, d.columns), name
        assert got.select(*CLASH).distinct().collect() == [("v",) * len(CLASH)], name


def test_short_items_of_several_lengths(spark):
    items = spark.createDataFrame([("a", "red"), ("b", "Red fox"), ("c", "red fox runs far away today"), ("d", "")], "item_id string, text string")
    texts = ["a red fox runs", "fox red", "RED FOX RUNS FAR AWAY TODAY", "nothing", None, "re d", "red"]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.decontaminate(docs(spark, texts), items).collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (6, 3), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (1, 1)}


def test_long_runs_of_digits_take_linear_time():
    import time

    t = time.time()
    assert pii.base_spans("1" * 1_000_000 + ".5") == []
    assert pii.base_spans("1." * 300_000)[0] == (0, 1, 7)
    assert time.time() - t < 5


def test_cut_off_of_hashes(spark):
    d = spark.range(20_000).select(F.xxhash64("id").alias("o")).unionByName(spark.range(5000).select(F.xxhash64(F.lit(3)).alias("o")))
    every = sorted(r[0] for r in d.distinct().collect())
    assert common.hash_cut(d, "o", 100, 20_000) == every[99] == common.hash_cut(d, "o", 100, 10**9) and common.hash_cut(d, "o", 10**6, 5) == every[-1]
    assert common.hash_cut(d.limit(0), "o", 5, 0) is None

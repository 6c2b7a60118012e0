"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions.

A tree of levels (domain, language, source) splits a token budget by its nodes' weights. A leaf supplies its tokens
once per epoch; what a leaf's share exceeds its supply by goes to its siblings first, and to other branches only
when all siblings are full. Each leaf then gives the prefix of its documents, in a seeded order that differs per
epoch, that holds its budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, free_names, n_words, sized, stored

LEVELS = ("domain", "lang", "source")
#: Rows of an order bucket of a leaf and epoch; documents are only sorted within the bucket in which a budget ends.
BUCKET_ROWS = 2_000
#: Buckets of a leaf at most (beyond, they get more rows): one task sums those of a leaf and epoch.
BUCKETS = 1 << 16


def split_budget(budget: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares in proportion to weights, none above its cap; what full ones leave goes to the others by weight."""
    got, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = min(budget, sum(caps[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if caps[i] <= left * weights[i] / total + 1e-9]
        if not full:
            for i in open_:
                got[i] = left * weights[i] / total
            return got
        for i in full:
            got[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return got


def leaf_budgets(supply: dict[tuple, int], budget: float, weights: dict[tuple, float], epochs: int) -> dict[tuple, int]:
    """Tokens of each leaf (a path of level values); nodes without a weight have 1, paths shorter than a leaf are branches."""
    out: dict[tuple, int] = {}

    def visit(path: tuple, leaves: dict[tuple, int], share: float) -> None:
        if len(leaves) == 1 and path in leaves:
            out[path] = int(share + 1e-6)
            return
        children: dict[tuple, dict[tuple, int]] = {}
        for leaf, n in leaves.items():
            children.setdefault(leaf[: len(path) + 1], {})[leaf] = n
        order = sorted(children, key=lambda p: tuple((x is not None, x or "") for x in p))
        shares = split_budget(share, [float(weights.get(c, 1.0)) for c in order], [float(sum(children[c].values()) * epochs) for c in order])
        for c, s in zip(order, shares):
            visit(c, children[c], s)

    if supply:
        visit((), supply, budget)
    return out


def mix(docs: DataFrame, weights: dict[tuple, float], share: float = 0.5, budget: int | None = None, epochs: int = 3, seed: int = 42, levels=LEVELS) -> DataFrame:
    """The chosen rows of docs (doc_id, text and the ``levels``), once per epoch that takes them.

    Adds epoch (from 0), n_tokens (words) and rank_hash (the place in the epoch's order). ``budget`` is in tokens,
    or ``share`` of all tokens. A document belongs to a leaf's prefix when the tokens before it are fewer than the
    budget, so a leaf exceeds its budget by less than its last document. Null level values are branches of their
    own; texts that are null or empty have no tokens and are never chosen. Repeated rows count and are chosen each
    (ties in the order are broken by doc_id and text, and rows equal in both are taken together). The number of
    leaves is that of the mix's configured sources: they are what reaches the driver.
    """
    spark = docs.sparkSession
    tokens = n_words(F.col("text"))
    new, n = ["epoch", "n_tokens", "rank_hash"], len(levels)
    names = free_names([*docs.columns, *new, "leaf", "goal", "buckets", "d", "t"], *(f"x{i}" for i in range(n)), *(f"y{i}" for i in range(n)), "x_d", "c_o", "c_d")
    xs, ys, (x_d, c_o, c_d) = names[:n], names[n : 2 * n], names[2 * n :]
    ids = docs.select(*(F.col(c).cast("string").alias(x) for c, x in zip(levels, xs)), F.xxhash64("doc_id", "text").alias("d"), tokens.alias("t"))
    ids = stored(ids.where("t > 0").groupBy(*xs, "d").agg(F.sum("t").alias("t")), "tokens")
    supply = {tuple(r[:-2]): (int(r[-2]), int(r[-1])) for r in ids.groupBy(*xs).agg(F.sum("t"), F.count("*")).toLocalIterator()}
    total = sum(t for t, _ in supply.values())
    goal = leaf_budgets({k: t for k, (t, _) in supply.items()}, float(budget if budget is not None else total * share), weights, epochs)
    plan, known = [], sorted(supply, key=str)
    for at, leaf in enumerate(known):
        for e in range(epochs):
            left = goal.get(leaf, 0) - e * supply[leaf][0]
            if left > 0:
                plan.append((*leaf, at, e, left, min(BUCKETS, max(1, supply[leaf][1] // BUCKET_ROWS))))
    fields = ", ".join(f"{y} string" for y in ys)
    plan_df = spark.createDataFrame(plan, f"{fields}, leaf int, epoch int, goal long, buckets long")
    plan_bytes = sum(64 + sum(4 * len(x or "") + 16 for x in row[: len(levels)]) for row in plan)
    on = None
    for x, y in zip(xs, ys):
        c = F.col(x).eqNullSafe(F.col(y))
        on = c if on is None else on & c
    order = F.xxhash64("d", F.lit(seed), "epoch")
    placed = ids.join(F.broadcast(plan_df) if plan_bytes <= BROADCAST_BYTES else plan_df, on)
    placed = placed.select("leaf", "epoch", "goal", "t", "d", order.alias("o"), "buckets")
    # the order's hashes are even, so equal ranges of them are buckets of about equal size
    bucket = F.floor((F.col("o").cast("double") / F.lit(2.0**64) + 0.5) * F.col("buckets")).cast("long")
    placed = placed.withColumn("b", F.least(bucket, F.col("buckets") - 1))
    sums = placed.groupBy("leaf", "epoch", "goal", "b").agg(F.sum("t").alias("s"))
    before = F.coalesce(F.sum("s").over(W.partitionBy("leaf", "epoch").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("before", before).where("before < goal").groupBy("leaf", "epoch").agg(F.max_by("b", "b").alias("b"), F.max_by("before", "b").alias("before"))
    last = stored(last, "last")
    end = placed.join(sized(last), ["leaf", "epoch", "b"])
    sofar = F.coalesce(F.sum("t").over(W.partitionBy("leaf", "epoch", "b").orderBy("o", "d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = end.withColumn("sofar", F.col("before") + sofar).where("sofar < goal").groupBy("leaf", "epoch").agg(F.max(F.struct("o", "d")).alias("cut"))
    cuts = cuts.select(F.col("leaf").alias("c_leaf"), F.col("epoch").alias("c_epoch"), F.col("cut.o").alias(c_o), F.col("cut.d").alias(c_d))
    small = stored(plan_df.join(cuts, (F.col("leaf") == F.col("c_leaf")) & (F.col("epoch") == F.col("c_epoch"))).select(*ys, "epoch", c_o, c_d), "cuts")
    d = docs.drop(*new).withColumns({x_d: F.xxhash64("doc_id", "text"), "n_tokens": tokens} | {x: F.col(c).cast("string") for c, x in zip(levels, xs)})
    out = d.join(sized(small), on).withColumn("rank_hash", F.xxhash64(x_d, F.lit(seed), "epoch"))
    ok = (F.col("rank_hash") < F.col(c_o)) | ((F.col("rank_hash") == F.col(c_o)) & (F.col(x_d) <= F.col(c_d)))
    return out.where(ok & (F.col("n_tokens") > 0)).drop(*xs, *ys, c_o, c_d, x_d)

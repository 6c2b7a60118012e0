"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides keep the smallest k-gram hash of every sliding group of ``window - k + 1`` k-grams, so each shared span
of ``window`` words holds a fingerprint that both sides kept. Fingerprints are joined, and every hit is extended
word by word to both sides; what reaches ``window`` equal words is a shared span. Equality is of the words
themselves: hashes only retrieve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, sized, stored

K, WINDOW = 4, 8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _gram(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + j) for j in range(n)))


def _winnowed(df: DataFrame, keep: list[str], k: int, window: int) -> DataFrame:
    """(keep..., h): the kept fingerprints of rows with columns words and wh; runs of one value give one row."""
    i, n = F.col("i"), window - k + 1
    at = df.where(F.size("words") >= window).select(*keep, "wh", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("i"))
    grams = at.select(*keep, "i", *(_gram(F.col("wh"), i + j, k).alias(f"g{j + 1}") for j in range(-1, n)))
    own = F.least(*(F.col(f"g{j + 1}") for j in range(n)))
    before = F.least(*(F.col(f"g{j}") for j in range(n)))
    return grams.select(*keep, own.alias("h"), ((i == 0) | (own != before)).alias("new")).where("new").select(*keep, "h")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))


def shared_spans(docs: DataFrame, items: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Spans of whole document texts that occur in items.

    docs: doc_id, text; items: item_id, text. Returns (doc_id, th, item_id, lo, hi): words lo..hi (0-based, both
    included) of the document whose text hashes to th are in a window that the item has. An item of fewer than
    ``window`` words, but not none, is one window. Null texts and items without an id have no words.
    """
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    it = _hashed(items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct())
    it = stored(it, "items")
    chosen = _winnowed(it, ["item_id"], k, window).distinct()
    reach = window - k
    at = it.where(F.size("words") >= window).select("item_id", "words", "wh", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("p"))
    at = at.select("item_id", _gram(F.col("wh"), F.col("p"), k).alias("h"), F.array(*(F.get("words", F.col("p") + j) for j in range(-reach, k + reach))).alias("near"))
    index = stored(at.join(chosen, ["item_id", "h"], "left_semi").distinct(), "fingerprints")
    marks = stored(index.select("h").distinct(), "marks")

    found = _winnowed(_hashed(d.select("doc_id", "th", words_of(F.col("text")).alias("words"))), ["doc_id", "th"], k, window)
    found = found.join(sized(marks), "h", "left_semi")
    found = stored(found.groupBy("doc_id", "th").agg(F.collect_set("h").alias("hs")), "candidates")
    c = sized(found.withColumnsRenamed({"doc_id": "c_id", "th": "c_th"}))
    hit = d.join(c, d.doc_id.eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th"))).dropDuplicates(["doc_id", "th"])
    hit = _hashed(hit.select("doc_id", "th", "hs", words_of(F.col("text")).alias("words")))
    hit = hit.select("doc_id", "th", "hs", "words", "wh", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("p"))
    hit = hit.select("doc_id", "th", "p", "words", "hs", _gram(F.col("wh"), F.col("p"), k).alias("h")).where(F.array_contains("hs", F.col("h")))
    hit = hit.select("doc_id", "th", "p", "h", F.array(*(F.get("words", F.col("p") + j) for j in range(-reach, k + reach))).alias("own"))
    hit = hit.join(sized(index), "h")

    def same(j: int) -> Column:
        return F.coalesce(F.get("own", F.lit(j + reach)) == F.get("near", F.lit(j + reach)), F.lit(False))

    def run(js: list[int]) -> Column:
        out = F.lit(len(js))
        for n in reversed(range(len(js))):
            out = F.when(~same(js[n]), F.lit(n)).otherwise(out)
        return out

    core = same(0)
    for j in range(1, k):
        core = core & same(j)
    hit = hit.where(core).select("doc_id", "th", "item_id", "p", run([-j for j in range(1, reach + 1)]).alias("left"), run(list(range(k, k + reach))).alias("right"))
    spans = hit.where(F.col("left") + F.col("right") + k >= window).select("doc_id", "th", "item_id", (F.col("p") - F.col("left")).alias("lo"), (F.col("p") + F.col("right") + (k - 1)).alias("hi"))

    lengths = [n for (n,) in it.where(F.size("words") < window).select(F.size("words")).distinct().collect()]  # at most window - 1
    if not lengths:
        return spans
    # all lengths of short items in one pass over the documents
    whole = F.coalesce(*(F.when(F.size("words") == n, _gram(F.col("wh"), F.lit(0), n)) for n in lengths))
    short = stored(it.where(F.size("words") < window).select("item_id", F.col("words").alias("whole"), F.size("words").alias("n"), whole.alias("h")), "short")
    own = _hashed(d.select("doc_id", "th", words_of(F.col("text")).alias("words"))).where(F.size("words") >= min(lengths))
    own = own.select("doc_id", "th", "words", "wh", F.explode(F.sequence(F.lit(0), F.size("words") - min(lengths))).alias("p"))
    kinds = F.array(*(F.struct(F.lit(n).alias("n"), F.when(F.col("p") + n <= F.size("words"), _gram(F.col("wh"), F.col("p"), n)).alias("h")) for n in lengths))
    own = own.select("doc_id", "th", "p", "words", F.explode(kinds).alias("x")).where("x.h is not null")
    own = own.select("doc_id", "th", "p", "x.n", "x.h", F.slice("words", F.col("p") + 1, F.col("x.n")).alias("here"))
    own = own.join(sized(short), ["n", "h"]).where("here = whole").select("doc_id", "th", "item_id", F.col("p").alias("lo"), (F.col("p") + (F.col("n") - 1)).alias("hi"))
    return spans.unionByName(own)


def _covered(spans: Column) -> Column:
    """Number of positions in a sorted array of structs lo, hi."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))

    def step(acc, s):
        return F.struct((acc.n + F.greatest(F.lit(0), s.hi - F.greatest(s.lo - 1, acc.end))).alias("n"), F.greatest(acc.end, s.hi).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: acc.n)


def decontaminate(docs: DataFrame, items: DataFrame, min_items: int = 2, k: int = K, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with n_words, n_hit, n_items, items_sha256 and contaminated added.

    Null or empty texts have no words and no hits (items_sha256 is then that of the empty string). Repeated rows
    each get their own equal result; rows of one doc_id with different texts are judged apart. Columns of these
    names that docs has already are replaced; other columns may have any name. An empty benchmark or an empty docs table gives no hits or no rows.
    """
    spans = shared_spans(docs, items, k, window)
    own = spans.groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"),
        F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("ids"),
    )
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    d = docs.drop(*names)
    th, h_id, h_th, hit, ids = free_names([*d.columns, *names], "x_th", "h_id", "h_th", "x_hit", "x_ids")
    own = stored(own.select(F.col("doc_id").alias(h_id), F.col("th").alias(h_th), _covered(F.col("s")).cast("long").alias(hit), F.col("ids").alias(ids)), "hits")
    d = d.withColumns({"n_words": F.size(words_of(F.col("text"))).cast("long"), th: F.xxhash64("text")})
    out = d.join(sized(own), F.col("doc_id").eqNullSafe(F.col(h_id)) & (F.col(th) == F.col(h_th)), "left")
    n_items = F.when(F.col(ids).isNull(), F.lit(0)).otherwise(F.size(ids)).cast("long")
    out = out.withColumns({
        "n_hit": F.coalesce(hit, F.lit(0).cast("long")), "n_items": n_items,
        "items_sha256": F.sha2(F.coalesce(F.array_join(ids, ","), F.lit("")), 256), "contaminated": n_items >= min_items,
    })
    return out.drop(th, h_id, h_th, hit, ids)

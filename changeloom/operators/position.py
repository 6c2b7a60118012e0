"""Log positions: event identifiers, transaction offsets, commits and sets of transaction numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def event_id(mode: str, *parts: Column | str) -> Column:
    """gtid: server uuid, transaction and offset; filepos: server id, file, position and row offset."""
    n = {"gtid": 3, "filepos": 4}.get(mode)
    if n is None or len(parts) != n:
        raise ValueError(f"{mode}: needs {n} parts")
    return F.concat_ws(".", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


def transaction_offset(transaction: list[str], seq: str = "seq") -> Column:
    """The place of an event in its transaction, from 0."""
    return (F.row_number().over(W.partitionBy(*transaction).orderBy(seq)) - 1).cast("long")


#: Consecutive sequence numbers, or transaction numbers, that one task puts in order.
SPAN = 1_000_000


def carried(df: DataFrame, source: list[str], seq: str, values: dict[str, Column], before: bool = False, span: int = SPAN) -> DataFrame:
    """Adds the last value that is not null up to each row (``before``: up to the one before) in the order of its source.

    Rows are put in order within ranges of ``span`` sequence numbers, and each range starts with what the ranges before it
    end with: no task sorts a whole log, whose ranges are few.
    """
    d = df.withColumns({"_range": F.floor(F.col(seq) / span).cast("long")} | {f"_v_{n}": c for n, c in values.items()})
    key = [*source, "_range"]
    ends = d.groupBy(*key).agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(seq))).alias(f"_e_{n}") for n in values))
    w = W.partitionBy(*source).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*key, *(F.last(f"_e_{n}", True).over(w).alias(f"_b_{n}") for n in values))
    own = W.partitionBy(*key).orderBy(seq).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    d = d.withColumns({n: F.last(f"_v_{n}", True).over(own) for n in values})
    right = ends.select(*(F.col(k).alias(f"_k_{k}") for k in key), *(f"_b_{n}" for n in values))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    d = d.join(right, on, "left")
    return d.withColumns({n: F.coalesce(n, f"_b_{n}") for n in values}).drop("_range", *(f"_v_{n}" for n in values), *(f"_b_{n}" for n in values), *(f"_k_{k}" for k in key))


def last_committed(df: DataFrame, position: str, committed: str, source: list[str], seq: str = "seq", out: str = "committed_pos") -> DataFrame:
    """Adds the position of the last commit up to each event of a log; a log is in order per ``source`` (server and file)."""
    return carried(df, source, seq, {out: F.when(F.col(committed), F.col(position))})


def explode_row_pairs(df: DataFrame, rows: str = "rows") -> DataFrame:
    """An update event's list before, after, before, after ... as one row per pair; an odd last one is left out."""
    n = F.floor(F.size(rows) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("row_index"), F.get(rows, i * 2).alias("old_values"), F.get(rows, i * 2 + 1).alias("new_values")))
    rest = [c for c in df.columns if c != rows]
    return df.where(n > 0).select(*rest, F.explode(pairs).alias("_p")).select(*rest, "_p.*")


def intervals(df: DataFrame, uuid: str = "uuid", txid: str = "txid", span: int = SPAN) -> DataFrame:
    """Runs of consecutive transaction numbers: uuid, lo, hi, n."""
    d = df.select(uuid, F.col(txid).alias("lo"), F.col(txid).alias("hi")).distinct()
    return merge_intervals(d, uuid, span).withColumn("n", F.col("hi") - F.col("lo") + 1)


def merge_intervals(df: DataFrame, uuid: str = "uuid", span: int = SPAN) -> DataFrame:
    """The union of intervals (uuid, lo, hi); neighbours and overlaps become one.

    Intervals are put in order within ranges of ``span`` numbers by their start; of each range only its largest end and
    its first start's are carried on to the others, so no task sorts a whole server. A start is a lo beyond all ends
    before it, plus one; its interval reaches to the largest end before the next start.
    """
    key = [uuid, "_range"]
    d = df.select(uuid, "lo", "hi", F.floor(F.col("lo") / span).cast("long").alias("_range"))
    earlier = W.partitionBy(uuid).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    tops = d.groupBy(*key).agg(F.max("hi").alias("_top")).withColumn("_carried", F.max("_top").over(earlier))
    d = _on(d, tops.select(*key, "_carried"), key)
    own = W.partitionBy(*key).orderBy("lo", "hi")
    d = d.withColumn("_before", F.greatest("_carried", F.max("hi").over(own.rowsBetween(W.unboundedPreceding, -1))))
    starts = d.where(F.col("_before").isNull() | (F.col("lo") > F.col("_before") + 1)).select(*key, "lo", "_before")
    # the largest end before the next range's first start; behind the last start, that of all
    later = W.partitionBy(uuid).orderBy("_range").rowsBetween(1, W.unboundedFollowing)
    firsts = starts.groupBy(*key).agg(F.min_by("_before", "lo").alias("_first"))
    last = tops.groupBy(uuid).agg(F.max("_top").alias("_last"))
    ends = _on(firsts, last, [uuid]).select(*key, F.coalesce(F.first("_first", True).over(later), "_last").alias("_end"))
    at = W.partitionBy(*key).orderBy("lo")
    starts = starts.select(*key, "lo", F.lead("_before").over(at).alias("_next"))
    return _on(starts, ends, key).select(uuid, "lo", F.coalesce("_next", "_end").alias("hi"))


def _on(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with the columns that ``other`` has for its key; null keys are equal."""
    right = other.withColumnsRenamed({k: f"_k_{k}" for k in key})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key))
    return df.join(right, on, "left").drop(*(f"_k_{k}" for k in key))


def parse_set(text: Column) -> Column:
    """'uuid:1-3:5,uuid2:7' as an array of structs uuid, lo, hi."""
    def one(part: Column) -> Column:
        bits = F.split(F.trim(part), ":")
        return F.transform(F.slice(bits, 2, F.size(bits) - 1), lambda r: F.struct(bits[0].alias("uuid"), F.split(r, "-")[0].cast("long").alias("lo"), F.get(F.split(r, "-"), F.size(F.split(r, "-")) - 1).cast("long").alias("hi")))
    return F.flatten(F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), one))


def set_text(df: DataFrame, uuid: str = "uuid", span: int = SPAN) -> DataFrame:
    """Merged intervals as the text of each server's set: uuid, gtid_set.

    Texts of ranges of ``span`` numbers are made first, so that only they come together for a server.
    """
    part = F.struct("lo", F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))).alias("t"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.t), ":")
    g = df.groupBy(uuid, F.floor(F.col("lo") / span).cast("long").alias("_range")).agg(joined(part).alias("t"))
    return g.groupBy(uuid).agg(joined(F.struct("_range", "t")).alias("t")).select(uuid, F.concat(F.col(uuid), F.lit(":"), F.col("t")).alias("gtid_set"))


def contains(sets: DataFrame, df: DataFrame, uuid: str = "uuid", txid: str = "txid") -> DataFrame:
    """Rows of df whose transaction is in the merged set."""
    s = sets.select(F.col(uuid).alias("_u"), "lo", "hi")
    return df.join(s, (F.col(uuid) == F.col("_u")) & F.col(txid).between(F.col("lo"), F.col("hi")), "left_semi")

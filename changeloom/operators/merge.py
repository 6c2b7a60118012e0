"""Net changes: the events of each primary key, in order, as one change at most."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DELETE, INSERT, UPDATE

NOOP = "noop"


def _with_previous(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return df.withColumn("_prev", F.lag("op").over(W.partitionBy(*keys).orderBy(seq)))


def _broken() -> Column:
    """An insert after anything but a delete, or an update after a delete."""
    return F.col("_prev").isNotNull() & (((F.col("op") == INSERT) & (F.col("_prev") != DELETE)) | ((F.col("op") == UPDATE) & (F.col("_prev") == DELETE)))


def violations(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The events that cannot follow the event before them, with its operation as ``previous_op``."""
    return _with_previous(df, keys, seq).where(_broken()).withColumnRenamed("_prev", "previous_op")


def net_changes(df: DataFrame, keys: list[str], seq: str = "seq", images: list[str] = ("new_row",), on_invalid: str = "error") -> DataFrame:
    """One row per key: keys, op (insert, update, delete or noop), the last event's ``images`` and originals.

    Images are full and null unless op is insert or update. The check of each event's predecessor and the sums use
    one shuffle on the keys. ``on_invalid='error'`` fails with the key of a sequence that cannot be; 'ignore' does not
    look. Ties of ``seq`` within a key are not defined: it must order a key's events.
    """
    if on_invalid == "error":
        df = _with_previous(df, keys, seq)
        what = F.concat(F.lit("invalid sequence for key "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)))
        df = df.withColumn("op", F.when(_broken(), F.raise_error(what).cast("string")).otherwise(F.col("op"))).drop("_prev")
    g = df.groupBy(*keys).agg(F.min_by("op", seq).alias("_first"), F.max_by("op", seq).alias("_last"), F.max_by(F.struct(*images), seq).alias("_image"), F.count("*").alias("originals"))
    op = F.when(F.col("_last") == DELETE, F.when(F.col("_first") == INSERT, NOOP).otherwise(DELETE)).when(F.col("_first") == INSERT, INSERT).otherwise(UPDATE)
    live = F.col("op").isin(INSERT, UPDATE)
    return g.withColumn("op", op).select(*keys, "op", *(F.when(live, F.col(f"_image.{c}")).alias(c) for c in images), "originals")


def net_changes_partial(df: DataFrame, keys: list[str], seq: str = "seq", image: str = "new_row", old: str = "old_row") -> DataFrame:
    """As :func:`net_changes` for map images that hold only some columns: later values overlay earlier ones.

    The fold starts anew after a delete. A row that was there before the log and comes back after its deletion has null
    in each column of the deleted row's ``old`` image (if there is one) that no image since then names; any other column
    that no image names is absent. Each column's latest value is an aggregate of its own, with map-side parts: no key's
    history is gathered.
    """
    w = W.partitionBy(*keys)
    start = F.max(F.when(F.col("op").isin(INSERT, DELETE), F.col(seq))).over(w)
    d = df.withColumns({"_start": start, "_gone": F.max(F.when(F.col("op") == DELETE, F.col(seq))).over(w), "_open": F.min_by("op", seq).over(w)})
    g = d.groupBy(*keys).agg(F.min_by("op", seq).alias("_first"), F.max_by("op", seq).alias("_last"), F.count("*").alias("originals"))
    named = F.when((F.col("op") != DELETE) & (F.col(seq) >= F.coalesce("_start", seq)), F.map_entries(image))
    if old in df.columns:
        lost = (F.col(seq) == F.col("_gone")) & (F.col("_open") != INSERT)
        null = F.transform(F.map_keys(old), lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value")))
        named = F.when(lost, null).otherwise(named)
    each = d.select(*keys, F.col(seq).alias("_at"), F.explode(named).alias("_e")).select(*keys, "_at", "_e.key", "_e.value")
    # the struct keeps a null that is the latest value
    each = each.groupBy(*keys, "key").agg(F.max_by(F.struct("value"), "_at").alias("v"))
    row = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "v.value"))).alias(image))
    op = F.when(F.col("_last") == DELETE, F.when(F.col("_first") == INSERT, NOOP).otherwise(DELETE)).when(F.col("_first") == INSERT, INSERT).otherwise(UPDATE)
    g = g.withColumn("op", op).join(row, keys, "left")
    empty = F.coalesce(image, F.create_map().cast("map<string,string>"))
    return g.select(*keys, "op", F.when(F.col("op").isin(INSERT, UPDATE), empty).alias(image), "originals")


def split_key_changes(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Updates (old_row and new_row are structs or maps) that move a row to another key become a delete and an insert.

    Other rows pass, also updates whose old image does not name the key. ``seq`` is doubled so that the insert follows
    its delete.
    """
    other = reduce(lambda a, b: a | b, (F.col("old_row")[k].isNotNull() & (F.col("old_row")[k] != F.col("new_row")[k]) for k in keys))
    moved = (F.col("op") == UPDATE) & F.coalesce(other, F.lit(False))
    null_new, null_old = (F.lit(None).cast(df.schema[c].dataType) for c in ("new_row", "old_row"))
    one = lambda op, old, new, n: F.struct(op.alias("op"), old.alias("old_row"), new.alias("new_row"), (F.col(seq) * 2 + n).alias(seq))
    two = F.array(one(F.lit(DELETE), F.col("old_row"), null_new, 0), one(F.lit(INSERT), null_old, F.col("new_row"), 1))
    rest = [c for c in df.columns if c not in ("op", "old_row", "new_row", seq)]
    out = df.withColumn("_x", F.when(moved, two).otherwise(F.array(one(F.col("op"), F.col("old_row"), F.col("new_row"), 0))))
    return out.select(*rest, F.explode("_x").alias("_x")).select(*rest, "_x.*")


def by_operation(net: DataFrame) -> dict[str, DataFrame]:
    """Inserts, updates and deletes of net changes, in the order in which they are written."""
    return {op: net.where(F.col("op") == op) for op in (INSERT, UPDATE, DELETE)}

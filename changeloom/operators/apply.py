"""Applying changes to a target table: joins that rewrite it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DELETE, INSERT, UPDATE
from .merge import NOOP, net_changes


def apply_net(target: DataFrame, net: DataFrame, keys: list[str], on_conflict: str = "log_wins", null_as_default: dict[str, object] | None = None) -> DataFrame:
    """The target after net changes (keys, op, and the target's other columns with new values).

    ``log_wins``: inserts and updates are upserts and a noop deletes, so replays converge. ``ignore``: an insert keeps
    a row that exists, an update needs one, a noop does nothing. ``null_as_default`` gives the values that updates
    write in place of null. The join is on the whole key.
    """
    values = [c for c in target.columns if c not in keys]
    defaults = null_as_default or {}
    t = target.withColumn("_there", F.lit(True))
    n = net.select(*keys, F.col("op").alias("_op"), *(F.col(c).alias(f"_n_{c}") for c in values))
    j = t.join(n, keys, "full_outer")
    there, op = F.coalesce("_there", F.lit(False)), F.coalesce("_op", F.lit("none"))

    def new(c: str) -> Column:
        x = F.col(f"_n_{c}")
        return F.when(op == UPDATE, F.coalesce(x, F.lit(defaults[c]))).otherwise(x) if c in defaults else x

    if on_conflict == "log_wins":
        keep, take = ~op.isin(DELETE, NOOP), op.isin(INSERT, UPDATE)
    elif on_conflict == "ignore":
        keep = F.when(op == DELETE, F.lit(False)).when(op == UPDATE, there).when(op == INSERT, F.lit(True)).otherwise(there)
        take = (op == UPDATE) | ((op == INSERT) & ~there)
    else:
        raise ValueError(f"on_conflict: {on_conflict}")
    return j.where(keep).select(*keys, *(F.when(take, new(c)).otherwise(F.col(c)).alias(c) for c in values)).select(*target.columns)


def apply_images(target: DataFrame, net: DataFrame, keys: list[str], on_conflict: str = "log_wins") -> DataFrame:
    """As :func:`apply_net` for net changes whose columns are in ``new_row``, a struct or a map of texts.

    Only columns that the image names are written: an update keeps the others, an insert of a new row leaves them null.
    Keys are of the target's types.
    """
    kinds, image = dict(target.dtypes), net.schema["new_row"].dataType
    values = [c for c in target.columns if c not in keys]

    def named(c: str) -> Column | None:
        if isinstance(image, T.MapType):
            return F.map_contains_key("new_row", F.lit(c))
        return F.lit(True) if c in image.names else None

    new = {c: (F.col("new_row")[c].cast(kinds[c]), has) for c in values if (has := named(c)) is not None}
    n = net.select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), F.col("op").alias("_op"), *(x for c, (v, has) in new.items() for x in (v.alias(f"_n_{c}"), has.alias(f"_h_{c}"))))
    j = target.withColumn("_there", F.lit(True)).join(n, keys, "full_outer")
    there, op = F.coalesce("_there", F.lit(False)), F.coalesce("_op", F.lit("none"))
    if on_conflict == "log_wins":
        keep, take = ~op.isin(DELETE, NOOP), op.isin(INSERT, UPDATE)
    elif on_conflict == "ignore":
        keep = F.when(op == DELETE, F.lit(False)).when(op == INSERT, F.lit(True)).otherwise(there)
        take = (op == UPDATE) | ((op == INSERT) & ~there)
    else:
        raise ValueError(f"on_conflict: {on_conflict}")
    cols = [F.when(take & F.col(f"_h_{c}"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in values]
    return j.where(keep).select(*keys, *cols).select(*target.columns)


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], seq: str = "seq", on_conflict: str = "log_wins", on_invalid: str = "error") -> DataFrame:
    """The target after an ordered change log with columns keys, seq, op and the target's other columns."""
    values = [c for c in target.columns if c not in keys]
    return apply_net(target, net_changes(changes, keys, seq, values, on_invalid), keys, on_conflict)


def apply_sequential(target: DataFrame, changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The target after each event by itself: inserts keep a row that exists, updates of no row do nothing.

    Per key only the events after its last delete count, and of them the first insert opens the row if there is
    none. Found by one aggregate over each key's events, without a fold in memory.
    """
    values = [c for c in target.columns if c not in keys]
    last_delete = changes.where(F.col("op") == DELETE).groupBy(*keys).agg(F.max(seq).alias("_cut"))
    c = changes.join(last_delete, keys, "left").where((F.col("op") != DELETE) & (F.col("_cut").isNull() | (F.col(seq) > F.col("_cut"))))
    t = target.select(*keys, F.struct(*values).alias("_t"))
    first = c.where(F.col("op") == INSERT).groupBy(*keys).agg(F.min(seq).alias("_open"), F.min_by(F.struct(*values), seq).alias("_opened"))
    c = c.join(first, keys, "left")
    late = c.where(F.col("op") == UPDATE).groupBy(*keys).agg(F.max(seq).alias("_at"), F.max_by(F.struct(*values), seq).alias("_u"))
    j = t.join(last_delete, keys, "full_outer").join(first, keys, "full_outer").join(late, keys, "full_outer")
    row = F.when(F.col("_cut").isNull() & F.col("_t").isNotNull(), F.coalesce("_u", "_t")).when(
        F.col("_open").isNotNull(), F.when(F.col("_at") > F.col("_open"), F.col("_u")).otherwise(F.col("_opened")))
    return j.withColumn("_row", row).where("_row is not null").select(*keys, "_row.*").select(*target.columns)


#: Rows of a target that one task puts in order.
TASK_ROWS = 500_000


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """The target without the rows of whole keys in ``gone``.

    The target is counted; one of more rows than ``rows`` for each core is dealt by key to tasks of about that many, so a
    task's memory does not grow with it, whatever the session's number of shuffle partitions.
    """
    gone, n = gone.select(*keys).distinct(), -(-target.count() // rows)
    if n <= target.sparkSession.sparkContext.defaultParallelism:
        return target.join(gone, keys, "left_anti")
    # an anti join would be pushed below the repartition, to the session's number of partitions
    gone = gone.repartition(n, *keys).withColumn("_gone", F.lit(True))
    return target.repartition(n, *keys).join(gone, keys, "left").where("_gone is null").select(*target.columns)

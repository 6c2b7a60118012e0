"""Data check: rows of a source that a target misses or holds differently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import older_than

MISS, DIFF = "row_miss", "row_diff"


def check_rows(source: DataFrame, target: DataFrame, keys: list[str], compare_binary: bool = False) -> DataFrame:
    """(keys, err, expected, real): rows missing in the target, and rows with any column that differs.

    One direction: more rows in the target are no error. Columns are the source's; one that the target lacks differs.
    Nulls are equal to nulls. Binary columns are left out unless asked for.
    """
    binary = {f.name for d in (source, target) for f in d.schema.fields if isinstance(f.dataType, T.BinaryType)}
    columns = [c for c in source.columns if c not in keys and (compare_binary or c not in binary)]
    own = [c for c in columns if c in target.columns]
    t = target.select(*keys, F.lit(True).alias("_there"), *(F.col(c).alias(f"_r_{c}") for c in own))
    j = source.join(t, keys, "left")
    differ = [~F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in own] + [F.lit(True)] * (len(own) < len(columns))
    err = F.when(F.col("_there").isNull(), MISS).when(reduce(lambda a, b: a | b, differ, F.lit(False)), DIFF)
    real = F.when(F.col("_there").isNotNull(), F.struct(*keys, *(F.col(f"_r_{c}").alias(c) for c in own)))
    return j.select(*keys, err.alias("err"), F.struct(*keys, *columns).alias("expected"), real.alias("real")).where("err is not null")


def recheck(found: DataFrame, source: DataFrame, keys: list[str], update_time: str | None = None, now: Column | str | None = None, skip_seconds: int = 0, kind: str = "time") -> DataFrame:
    """Found rows that still stand: the source row is still there and, for a difference, was not changed of late."""
    if update_time is None:
        return found
    miss = found.where(F.col("err") == MISS).join(source.select(*keys), keys, "left_semi")
    old = source.where(older_than(F.col(update_time), now if now is not None else F.current_timestamp(), skip_seconds, kind))
    return miss.unionByName(found.where(F.col("err") == DIFF).join(old.select(*keys), keys, "left_semi"))


def report_lines(found: DataFrame, database: str, table: str) -> DataFrame:
    """One text line per finding, as the check's result file holds them."""

    def fields(c: str) -> Column:
        names = found.schema[c].dataType.names
        return F.concat_ws(" ", *(F.concat(F.lit(f"{n}:"), F.coalesce(F.col(f"{c}.{n}").cast("string"), F.lit("null"))) for n in names))

    real = F.when(F.col("real").isNull(), F.lit("")).otherwise(F.concat(F.lit(" real:"), fields("real")))
    return found.select(F.concat(F.lit("err:"), F.col("err"), F.lit(f" db:{database} table:{table}  - expected:"), fields("expected"), real).alias("line"))

"""Snapshot scans: tables found by name, read whole or by key pages, as insert events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import INSERT, ChangeError


#: Databases of the server itself.
SYSTEM = ("mysql", "information_schema", "performance_schema", "sys")


def find_tables(spark: SparkSession, pattern: str) -> list[str]:
    """'db.table' names of the catalog's base tables with a match of ``pattern``, sorted."""
    names = [f"{d.name}.{t.name}" for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name) if not t.isTemporary and t.tableType != "VIEW"]
    return sorted(n for n in names if re.search(pattern, n))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database, read by ranges of its integer key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions), **options).load()


def from_key(keys: list[str], bound: list) -> Column:
    """Rows at or after a key, in the form that reaches the scan: a > x OR (a = x AND (b >= y ...))."""
    if not keys or len(keys) != len(bound):
        raise ChangeError("a scan needs a primary key and a bound for each of its columns")
    c = F.col(keys[-1]) >= F.lit(bound[-1])
    for k, b in reversed(list(zip(keys[:-1], bound[:-1]))):
        c = (F.col(k) > F.lit(b)) | ((F.col(k) == F.lit(b)) & c)
    return c


def key_page(df: DataFrame, keys: list[str], size: int, bound: list | None = None) -> DataFrame:
    """The ``size`` rows from ``bound`` on in key order, and one more, which is the next page's bound."""
    if not keys:
        raise ChangeError("a scan needs a primary key")
    return (df.where(from_key(keys, bound)) if bound is not None else df).orderBy(*keys).limit(size + 1)


def matching(names: list[tuple[str, str]], pattern: str) -> list[tuple[str, str]]:
    """The (database, table) names outside the server's own databases whose 'db.table' has a match of ``pattern``."""
    return sorted(n for n in names if n[0].lower() not in SYSTEM and re.search(pattern, ".".join(n)))


def key_ranges(df: DataFrame, keys: list[str], size: int, most: int = 1000) -> list[DataFrame]:
    """The table as ranges of its key of about ``size`` rows, at most ``most`` of them, each a filter that reaches the scan.

    Bounds are those of a bounded sample in key order; they are the same in each run as long as the table is.
    """
    if not keys:
        raise ChangeError("a scan needs a primary key")
    n = df.count()
    parts = min(most, -(-n // size))
    if parts < 2:
        return [df]
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    some = df.select(*keys).where(h < int((1 << 30) * min(1.0, 50 * parts / n))).orderBy(*keys).collect()  # about 50 rows a range
    cuts = sorted({tuple(some[i * len(some) // parts]) for i in range(1, parts)}) if some else []
    out, low = [], None
    for cut in [*cuts, None]:
        d = df if low is None else df.where(from_key(keys, list(low)))
        out.append(d if cut is None else d.where(~from_key(keys, list(cut))))
        low = cut
    return out


def as_rows(df: DataFrame, database: str, table: str, keys: list[str]) -> DataFrame:
    """Each row as an insert in positional form (``model.DML``) with its columns' names; seq follows no order, as each key comes once."""
    now = F.unix_timestamp()
    null = F.lit(None).cast("array<string>")
    name, values = f"{database}.{table}", F.array(*(F.col(f"`{c}`").cast("string") for c in df.columns))
    key = F.concat_ws(".", F.lit(name), *(F.col(k).cast("string") for k in keys))
    return df.select(
        key.alias("id"), F.monotonically_increasing_id().alias("seq"), F.lit(name).alias("full_table_name"), F.lit(INSERT).alias("op"), null.alias("old_values"),
        values.alias("new_values"), now.alias("db_time"), (now * 1_000_000_000).alias("event_time"), F.array(*map(F.lit, df.columns)).alias("columns"))


def as_inserts(df: DataFrame, database: str, table: str, keys: list[str]) -> DataFrame:
    """Each row as a typed insert event with its key as the scan position."""
    if not keys:
        raise ChangeError("the table has no primary key")
    return df.select(F.lit(database).alias("database"), F.lit(table).alias("table"), F.lit(INSERT).alias("op"), F.struct("*").alias("new_row"), F.struct(*keys).alias("scan_pos"))


def progress(done: DataFrame, total: DataFrame) -> DataFrame:
    """Per table: the last finished key, finished and total counts and whether the scan is done.

    done: database, table, scan_pos of acknowledged rows; total: database, table, total_count (real counts).
    """
    d = done.groupBy("database", "table").agg(F.max("scan_pos").alias("last_pos"), F.count("*").alias("finished_count"))
    j = total.join(d, ["database", "table"], "left").withColumn("finished_count", F.coalesce("finished_count", F.lit(0).cast("long")))
    return j.withColumn("done", F.col("finished_count") >= F.col("total_count"))

"""Targets as versioned snapshots, and the projections of messages to topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ChangeError
from ..operators.apply import apply_images
from ..operators.merge import net_changes


class SnapshotTable:
    """A parquet table of numbered versions: whole ones (v=N) and batches of changes since then (d=N).

    Readers see the last whole version with the later changes' net effect. A version's folder is complete once Spark has
    written its _SUCCESS file, so an unfinished one is never read. A version may carry the token of the batch that made
    it (v=N@token); a batch whose token is there is not written again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None):
        self.spark, self.path, self.keys = spark, path, keys
        jvm = spark.sparkContext._jvm
        self._hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[tuple[int, str, str | None]]:
        """(number, folder, token) of the complete versions, in order; changes have folders that begin with d=."""
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path))]
        done = [n for n in names if n[:2] in ("v=", "d=") and self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS"))]
        return sorted((int(n[2:].partition("@")[0]), n, n.partition("@")[2] or None) for n in done)

    def versions(self) -> list[int]:
        return [n for n, _, _ in self.log()]

    def base(self) -> DataFrame:
        """The last whole version."""
        whole = [n for _, n, _ in self.log() if n[0] == "v"]
        if not whole:
            raise ChangeError(f"no version of the table at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{whole[-1]}")

    def read(self) -> DataFrame:
        log = self.log()
        base, at = self.base(), max(n for n, f, _ in log if f[0] == "v")
        later = [f"{self.path}/{f}" for n, f, _ in log if n > at]
        if not later:
            return base
        changes = self.spark.read.parquet(*later)
        keys = self.keys or [c[4:] for c in changes.columns if c.startswith("key:")]
        changes = changes.select("seq", "op", "new_row", *(F.col(f"`key:{k}`").alias(k) for k in keys))
        return apply_images(base, net_changes(changes, keys, images=["new_row"], on_invalid="ignore"), keys)

    def write(self, df: DataFrame, version: int | None = None, token: str | None = None, again: bool = False) -> bool:
        """A whole version. False if the version, or one with the token (unless ``again``), is there already."""
        return self._put("v", df, version, token, again)

    def append(self, changes: DataFrame, token: str | None = None, keys: list[str] | None = None) -> bool:
        """A batch of changes: keys, seq, op and new_row, a struct or map of the columns that are written."""
        keys = keys or self.keys
        return self._put("d", changes.select("seq", "op", "new_row", *(F.col(k).alias(f"key:{k}") for k in keys)), None, token)

    def compact(self, every: int = 8) -> None:
        """Writes a whole version once ``every`` batches of changes have come since the last one, and drops older ones."""
        log = self.log()
        at = max(n for n, f, _ in log if f[0] == "v")
        if sum(n > at for n, _, _ in log) >= every:
            self.write(self.read(), token=log[-1][2], again=True)
            self.drop_before(at)  # what readers under way may use stays until the next time

    def _put(self, kind: str, df: DataFrame, version: int | None, token: str | None, again: bool = False) -> bool:
        log = self.log()
        if token is not None and not again and any(t == token for _, _, t in log):
            return False
        if version is not None and any(n == version for n, _, _ in log):
            return False
        n = version if version is not None else (log[-1][0] + 1 if log else 0)
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}={n}" + (f"@{token}" if token else ""))
        return True

    def drop_before(self, version: int) -> None:
        for n, f, _ in self.log():
            if n < version:
                self._fs.delete(self._hadoop(f"{self.path}/{f}"), True)


class Folder:
    """A folder of tables: <path>/<database>/<table>, each a SnapshotTable, or plain parquet for reading."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p = self._hadoop(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.getPath().getName()[0] not in "._") if self._fs.exists(p) else []

    def tables(self) -> list[tuple[str, str]]:
        return [(d, t.removesuffix(".parquet")) for d in self._names(self.path) for t in self._names(f"{self.path}/{d}")]

    def snapshot(self, database: str, table: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.path}/{database}/{table}")

    def read(self, database: str, table: str) -> DataFrame:
        s = self.snapshot(database, table)
        if s.versions():
            return s.read()
        name = next((n for n in self._names(f"{self.path}/{database}") if n in (table, f"{table}.parquet")), None)
        if name is None:
            raise ChangeError(f"no table {database}.{table} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{database}/{name}")


def route_key(df: DataFrame, value: str = "value", topic: str | None = None, topic_var: str | None = None, key_var: str | None = None, extra: list[str] = ()) -> DataFrame:
    """topic, key and value of each message (and ``extra`` columns): a fixed topic or a variable's; an unset variable fails."""
    if not topic and not topic_var:
        raise ChangeError("a topic or a topic variable is needed")

    def var(c: str):
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"variable {c} is not set")).cast("string")).otherwise(F.col(c).cast("string"))

    return df.select((var(topic_var) if topic_var else F.lit(topic)).alias("topic"), (var(key_var) if key_var else F.lit(None).cast("string")).alias("key"), F.col(value).alias("value"), *extra)


def within_size(df: DataFrame, value: str = "value", most: int = 10 << 20, block: bool = False) -> DataFrame:
    """Messages of at most ``most`` bytes; with ``block`` a larger one fails instead of being left out."""
    ok = F.octet_length(value) <= most
    if block:
        return df.withColumn(value, F.when(ok, F.col(value)).otherwise(F.raise_error(F.lit("message too large")).cast("string")))
    return df.where(ok)


def queue_of(n: int, *columns: str):
    """The queue that a change goes to: the same for all changes of a table, or of a key if its columns are given."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")

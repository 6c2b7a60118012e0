"""Shared storage, joins and connected components for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most this many counted bytes may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Edges that one task makes stars of at most.
BLOCK = 1_000_000
#: Spark's setting for removing the shuffle files of an execution at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), one of our own is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="changeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and survives lost executors.

    The write's shuffle files go when it ends, as later plans read the table; the session's setting is put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a table made by :func:`stored` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, those of strings and arrays as they are, with 16 for each column and element."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            own = F.octet_length(c)
        elif kind == "array<string>":
            own = F.aggregate(c, F.lit(0), lambda a, x: a + 16 + F.coalesce(F.octet_length(x), F.lit(0)))
        elif kind.startswith("array<") and "<" not in kind[6:] and "string" not in kind and "binary" not in kind:
            own = 16 * F.size(c)
        elif "<" in kind:
            own = F.octet_length(F.to_json(F.struct(c)))
        else:
            own = F.lit(0)
        total = total + 16 + F.coalesce(own, F.lit(0))
    return total


def sized(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast of a stored table only if the counted bytes of its rows are within ``limit``; else Spark shuffles."""
    n = small.agg(F.sum(row_bytes(small))).first()[0] or 0
    return F.broadcast(small) if n <= limit else small


def free_names(taken, *names: str) -> list[str]:
    """``names``, each with as many '_' behind it as make it differ from the ``taken`` column names and the others."""
    seen, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in seen:
            n += "_"
        seen.add(n.lower())
        out.append(n)
    return out


def quoted(columns) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def hash_cut(df: DataFrame, column: str, k: int, n: int) -> int | None:
    """The ``k``-th smallest distinct value of a hash column of about ``n`` distinct ones, or its largest; None without any.

    Only values below a cut-off that leaves about 1.5 k of them move, so what one task gets does not grow with the
    number of partitions; a cut-off that leaves too few is raised.
    """
    share = 1.0 if n <= 2 * k else 1.5 * k / n
    while True:
        d = df if share >= 1 else df.where(F.col(column) < int(-(2**63) + share * 2**64))
        low = [r[0] for r in d.select(column).distinct().orderBy(column).limit(k).collect()]
        if len(low) >= k or share >= 1:
            return low[-1] if low else None
        share *= 4


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts of single-byte characters take the fast path. Null gives ''."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, up, up.lower()))


def n_words(text: Column) -> Column:
    """Number of runs without \\x20 and \\x09-\\x0D; null gives 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) connect it with."""
    root = np.arange(n)
    while True:
        was = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == was).all():
            return root


def _stars(u: str, v: str, whole: bool):
    """A block's edges (u, v) as stars: each node with the smallest node that the block connects it with; ``whole``: that too."""

    def run(frames):
        parts = list(frames)
        a, b = (np.concatenate([p[c].to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for c in (u, v))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[roots(at[: len(a)], at[len(a) :], len(nodes))]
        yield pd.DataFrame({"u": nodes, "v": root})[(nodes != root) | whole]

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b: long).

    Returns (node, component): one row for each node that has an edge to another node, component being its
    smallest node. Blocks of BLOCK edges at most are made stars in one task each; one block is done with that, several
    go on in alternating large and small stars. Every round is written to the shared folder; nothing is collected but
    two numbers. The least neighbours are stored before edges are joined to them, so that no join hangs on its own
    edges' grouping and Spark can split the partition of a node with very many edges.
    """
    e = stored(edges.where("a <> b").select("a", "b"), "edges")
    blocks = -(-e.count() // BLOCK)
    if blocks < 2:
        return e.coalesce(1).mapInPandas(_stars("a", "b", True), "u long, v long").toDF("node", "component")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def swapped(df: DataFrame, old: DataFrame) -> DataFrame:
        df = stored(df, "edges")
        drop_stored(old)
        return df

    e = swapped(e.repartition(blocks).mapInPandas(_stars("a", "b", False), "u long, v long").distinct(), e)
    was = mark(e)
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = sym.join(sized(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(sized(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = swapped(small.select("x.*").where("u <> v").distinct(), e)
        now = mark(e)
        for old in (low, large, least):
            drop_stored(old)
        if now == was:
            break
        was = now
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)

"""Replication logs as tables of raw events: decoding to row changes, commits, server facts, fail-over and DDL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ChangeError
from ..operators.position import carried, event_id
from .changelog import explode_events

#: A raw log: kind is gtid, query, xid, rotate or a row event's name; rows hold images in the order of the event.
RAW = T.StructType([T.StructField(n, t) for n, t in (
    ("seq", T.LongType()), ("kind", T.StringType()), ("server_id", T.LongType()), ("server_uuid", T.StringType()), ("txid", T.LongType()),
    ("file", T.StringType()), ("pos", T.LongType()), ("timestamp", T.LongType()), ("database", T.StringType()), ("table", T.StringType()),
    ("rows", T.ArrayType(T.ArrayType(T.StringType()))), ("query", T.StringType()))])
_ROWS = r"(?i)^(write|update|delete)_rows"
_NAME = r"(?:`[^`]+`|\"[^\"]+\"|[\w$]+)"
_DDL = re.compile(rf"^\s*(create|drop|alter|truncate|rename)\s+(?:temporary\s+)?(database|schema|table)?\s*(?:if\s+(?:not\s+)?exists\s+)?(.*)$", re.I | re.S)
_FULL = re.compile(rf"\s*({_NAME})(?:\s*\.\s*({_NAME}))?")


def ddl_targets(query: str, database: str = "") -> list[tuple[str, str | None]]:
    """The (database, table) names whose schema a statement may change; table is None for a whole database.

    CREATE and DROP DATABASE; CREATE, DROP, ALTER, TRUNCATE and RENAME TABLE. Names without a database take the
    session's. Other statements give none.
    """
    m = _DDL.match(re.sub(r"/\*.*?\*/", " ", query, flags=re.S))
    if not m or (not m[2] and m[1].lower() != "truncate"):
        return []
    verb, what, rest = m[1].lower(), (m[2] or "table").lower(), m[3]
    plain = lambda x: x.strip('`"') if x else x
    if what != "table":
        return [(plain(n[1]), None)] if verb in ("create", "drop") and (n := _FULL.match(rest)) else []
    parts = [rest] if verb in ("create", "alter", "truncate") else rest.split(",")
    if verb == "rename":
        parts = [x for p in parts for x in re.split(r"\s+to\s+", p, flags=re.I)]
    if verb == "alter" and (to := re.search(rf"\brename\s+(?:to\s+|as\s+)?({_NAME}(?:\s*\.\s*{_NAME})?)\s*$", rest, re.I)):
        parts.append(to[1])
    names = [n for p in parts if (n := _FULL.match(p))]
    return [(plain(n[1]), plain(n[2])) if n[2] else (database, plain(n[1])) for n in names]


def commits(log: DataFrame) -> DataFrame:
    """Adds ``commit``: an XID, any query but BEGIN (an implicit commit), and the event before a GTID that follows an open transaction."""
    k = F.lower("kind")
    own = (k == "xid") | ((k == "query") & (F.upper(F.trim("query")) != "BEGIN"))
    # a transaction that is open when the next one starts is committed by that one's GTID
    d = log.withColumn("_edge", F.when(own, F.lit(True)).when((k == "query") | k.rlike(_ROWS), F.lit(False)))
    d = carried(d, ["server_id"], "seq", {"_was": F.col("_edge")}, before=True)
    return d.withColumn("commit", own | ((k == "gtid") & F.coalesce(~F.col("_was"), F.lit(False)))).drop("_edge", "_was")


def decode(log: DataFrame, mode: str = "gtid") -> DataFrame:
    """Raw events as positional row changes in the form of ``model.DML``, with ``pos``, the position that a restart takes.

    id is uuid.txid.offset (gtid) or server.file.pos.row (filepos). seq orders the rows of all events. pos is the last
    commit before the row's transaction (file and pos), so a restart there replays the whole open transaction.
    """
    if mode not in ("gtid", "filepos"):
        raise ChangeError("ReplicationMode is gtid or filepos")
    d = commits(log)
    gtid = F.when(F.lower("kind") == "gtid", F.struct("server_uuid", "txid", F.col("seq").alias("start")))
    done = F.when(F.col("commit"), F.struct("file", "pos"))
    d = carried(d, ["server_id"], "seq", {"_tx": gtid, "_done": done})
    d = d.where(F.col("kind").rlike(_ROWS)).select("seq", "kind", "server_id", "file", F.col("pos").alias("at"), "timestamp", "database", "table", "rows", "_tx", "_done")
    d = explode_events(d)
    # an event's rows take the places behind its number; transactions are small, so offsets are counted within them
    offset = F.row_number().over(W.partitionBy("server_id", "_tx").orderBy("seq", "row_index")) - 1
    if mode == "gtid":
        d = d.withColumn("id", F.when(F.col("_tx").isNull(), F.raise_error(F.lit("a row event before any GTID")).cast("string")).otherwise(event_id("gtid", F.col("_tx.server_uuid"), F.col("_tx.txid"), offset)))
    else:
        d = d.withColumn("id", event_id("filepos", "server_id", "file", "at", "row_index"))
    return d.select(
        "id", (F.col("seq") * 1_000_000 + F.col("row_index")).alias("seq"), F.concat_ws(".", "database", "table").alias("full_table_name"), "op", "old_values", "new_values",
        F.col("timestamp").alias("db_time"), (F.col("timestamp") * 1_000_000_000).alias("event_time"), F.col("_done").alias("pos"))


def server_info(log: DataFrame) -> dict:
    """What a server tells of itself: server_id, server_uuid, file and pos of its last event, and whether it writes GTIDs."""
    r = log.agg(F.max_by(F.struct("server_id", "server_uuid", "file", "pos"), "seq").alias("s"), F.max(F.lower("kind") == "gtid").alias("g")).first()
    if r.s is None:
        raise ChangeError("the log is empty")
    uuid = r.s.server_uuid or (log.where("server_uuid is not null").select("server_uuid").first() or [None])[0]
    return {"server_id": r.s.server_id, "server_uuid": uuid, "file": r.s.file, "pos": r.s.pos, "gtid": bool(r.g)}


def choose_mode(wanted: str | None, info: dict) -> str:
    """gtid needs a server that writes GTIDs; without a wish, gtid if it does, else filepos."""
    if wanted == "gtid" and not info["gtid"]:
        raise ChangeError("the server writes no GTIDs")
    if wanted not in (None, "", "gtid", "filepos"):
        raise ChangeError("ReplicationMode is gtid or filepos")
    return wanted or ("gtid" if info["gtid"] else "filepos")


def from_position(log: DataFrame, file: str | None = None, pos: int | None = None, executed: DataFrame | None = None) -> DataFrame:
    """The events at or after a file position; with ``executed`` (uuid, lo, hi), of transactions that are not in that set."""
    if executed is None:
        return log if file is None else log.where((F.col("file") > file) | ((F.col("file") == file) & (F.col("pos") >= pos)))
    d = carried(log, ["server_id"], "seq", {"_tx": F.when(F.lower("kind") == "gtid", F.struct("server_uuid", "txid"))})
    hit = (F.col("_tx.server_uuid") == F.col("uuid")) & F.col("_tx.txid").between(F.col("lo"), F.col("hi"))
    return d.join(executed.select("uuid", "lo", "hi"), hit, "left_anti").drop("_tx")


def reachable(spark: SparkSession, addresses: list[str]) -> str:
    """The first address (a folder of log files) that can be listed: the primary, else the backup."""
    jvm = spark.sparkContext._jvm
    for a in filter(None, addresses):
        p = jvm.org.apache.hadoop.fs.Path(a)
        try:
            if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                return a
        except Exception:  # noqa: BLE001, S112 - any failure to reach an address means the next one
            continue
    raise ChangeError(f"no address can be reached: {', '.join(filter(None, addresses))}")


def same_hosts(before: Column, now: Column) -> Column:
    """Whether two lists of a name's addresses are the same hosts; a change means that the source has moved."""
    return F.array_sort(F.array_distinct(before)) == F.array_sort(F.array_distinct(now))

"""Registered queries that run whole tasks: log, scan, topic and check, each from its JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as N
from ..sinks.tables import Folder
from ..sources import binlog
from .catalogue import _WINS, NET, _dml, _query, _seed, _t, _work, changes
from .tasks import load_task

_LONG = [{"name": "id", "type": "bigint", "key": "PRI"}, {"name": "total", "type": "decimal(18,2)"}]


def _run(spark, source: dict, processors: list[dict], output: dict, **more):
    return load_task({"Task": {"ID": "query", "Pipeline": {"Type": "DisruptorPipeline", "Input": source, "Processors": processors, "Output": output}} | more}, spark).run()


def _target(spark, path: str, table: str, df) -> None:
    Folder(spark, path).snapshot("shop", table).write(df)


def _read(spark, path: str, table: str):
    return Folder(spark, path).read("shop", table)


def _totals(spark, sf, more: int = 0):
    return _seed(spark, sf).select(F.col("o_orderkey").alias("id"), (F.col("new_total") + more).cast("decimal(18,2)").alias("total"))


_SEEDS, _WON = _WINS.split("SELECT coalesce", 1)
_SEEDED = NET + _SEEDS + ", w AS (SELECT coalesce" + _WON + ")"


@_query(_SEEDED + " SELECT 'a' AS name, o_orderkey AS id, CAST(CAST(new_total AS DECIMAL(18,2)) AS DOUBLE) AS total FROM w UNION ALL SELECT 'b', o_orderkey, CAST(CAST(new_total AS DECIMAL(18,2)) + 1000 AS DOUBLE) FROM w")
def task_log_two_tables(spark, sf):
    """Two tables with equal keys in one log: each change goes to its own."""
    d = _work(spark)
    log = _dml(spark, sf)
    more = lambda c: F.transform(c, lambda x, i: F.when(i == 0, x).otherwise((x.cast("decimal(18,2)") + 1000).cast("decimal(18,2)").cast("string")))
    a = log.withColumn("full_table_name", F.lit("shop.a"))
    b = log.select("id", (F.col("seq") + 1_000_000_000).alias("seq"), F.lit("shop.b").alias("full_table_name"), "op", more("old_values").alias("old_values"), more("new_values").alias("new_values"))
    a.unionByName(b).write.parquet(f"{d}/log")
    _target(spark, f"{d}/to", "a", _totals(spark, sf))
    _target(spark, f"{d}/to", "b", _totals(spark, sf, 1000))
    _run(spark, {"Type": "MysqlBinlogInput", "Path": f"{d}/log"}, [{"Type": "MysqlDMLFilter", "FullTableNamePattern": r"^shop\."}, {"Type": "MysqlDMLToDBChangeConverter"}], {"Type": "MysqlBatchOutput", "Path": f"{d}/to", "TableConcurrency": 2}, Schemas={r"shop\..*": _LONG})
    out = [_read(spark, f"{d}/to", t).select(F.lit(t).alias("name"), "id", F.col("total").cast("double").alias("total")) for t in "ab"]
    return out[0].unionByName(out[1])


@_query("SELECT CASE WHEN o_orderkey%10=0 THEN -o_orderkey ELSE o_orderkey END AS id, o_totalprice AS total FROM orders")
def task_key_change(spark, sf):
    """Updates that move a row to another key leave no row behind."""
    d = _work(spark)
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    s = lambda *c: F.array(*(x.cast("string") for x in c))
    log = o.where("id % 10 = 0").select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), F.lit("shop.a").alias("full_table_name"), F.lit("update").alias("op"), s(F.col("id"), F.col("total")).alias("old_values"), s(-F.col("id"), F.col("total")).alias("new_values"))
    log.write.parquet(f"{d}/log")
    _target(spark, f"{d}/to", "a", o)
    _run(spark, {"Type": "MysqlBinlogInput", "Path": f"{d}/log"}, [{"Type": "MysqlDMLToDBChangeConverter", "Columns": ["id", "total"]}], {"Type": "MysqlBatchOutput", "Path": f"{d}/to", "Keys": ["id"]})
    return _read(spark, f"{d}/to", "a")


@_query("SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status FROM orders")
def task_scan_apply(spark, sf):
    """A table found by name, scanned in key ranges, written to a target that the task's schemas make."""
    d = _work(spark)
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    o.write.parquet(f"{d}/from/shop/orders1")
    schema = [{"name": "id", "type": "bigint", "key": "PRI"}, {"name": "customer", "type": "bigint"}, {"name": "status", "type": "varchar(1)"}]
    size = max(1, o.count() // 3)
    source = {"Type": "MysqlScanInput", "Path": f"{d}/from", "TableNameRegex": r"^shop\.orders\d", "BatchSize": size, "Keys": ["id"]}
    _run(spark, source, [{"Type": "MysqlDMLToDBChangeConverter"}], {"Type": "MysqlStreamOutput", "Path": f"{d}/to"}, Schemas={r"shop\.orders\d": schema})
    return _read(spark, f"{d}/to", "orders1")


@_query(_SEEDED + " SELECT o_orderkey AS id, CAST(CAST(new_total AS DECIMAL(18,2)) AS DOUBLE) AS total FROM w")
def task_json_apply(spark, sf):
    """From a log to a topic with routed keys, and from the topic to a table."""
    d = _work(spark)
    _dml(spark, sf).withColumn("full_table_name", F.lit("shop.orders")).write.parquet(f"{d}/log")
    _run(spark, {"Type": "MysqlBinlogInput", "Path": f"{d}/log"}, [
        {"Type": "DBTableNameCatcher", "DBNameVariable": "db", "TableNameVariable": "logical", "TableNamePattern": "^([a-z]+)"}, {"Type": "MysqlDMLToDBChangeConverter", "Columns": ["id", "total"]},
        {"Type": "ColumnValueProcessor", "TableNameVariable": "logical", "TableColumnMappings": {"orders": "id"}, "OutputVariable": "k"}, {"Type": "ValueMapper", "InputVariable": "db", "Mappings": {"shop": "changes"}, "OutputVariable": "to"},
        {"Type": "JsonMarshaller"}], {"Type": "KafkaOutput", "Path": f"{d}/topics", "TopicVariable": "to", "KeyVariable": "k"})
    _target(spark, f"{d}/to", "orders", _totals(spark, sf))
    _run(spark, {"Type": "KafkaInput", "Path": f"{d}/topics", "Topics": ["changes"]}, [{"Type": "DBChangeUnmarshaller"}], {"Type": "MysqlBatchOutput", "Path": f"{d}/to", "Keys": {r"shop\.orders": ["id"]}})
    return _read(spark, f"{d}/to", "orders").select("id", F.col("total").cast("double").alias("total"))


@_query("""SELECT 'err:row_miss db:shop table:orders  - expected:id:'||o_orderkey||' at:'||(o_orderkey*1000)||' status:'||o_orderstatus AS line FROM orders WHERE o_orderkey%7=0 UNION ALL
SELECT 'err:row_diff db:shop table:orders  - expected:id:'||o_orderkey||' at:'||(o_orderkey*1000)||' status:'||o_orderstatus||' real:id:'||o_orderkey||' at:'||(o_orderkey*1000)||' status:X' FROM orders WHERE o_orderkey%7<>0 AND o_orderkey%11=0 AND o_orderkey*1000 < 950400-60""")
def task_check_recheck(spark, sf):
    """A scan checked against a replica; rows changed of late are passed over."""
    d = _work(spark)
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") * 1000).alias("at"))
    o.write.parquet(f"{d}/from/shop/orders")
    _target(spark, f"{d}/to", "orders", o.where("id % 7 <> 0").withColumn("status", F.when(F.col("id") % 11 == 0, "X").otherwise(F.col("status"))))
    p = {"Type": "MysqlCheckOutput", "Path": f"{d}/to", "Keys": ["id"], "UpdateTimeColumn": "at", "UpdateTimeType": "sec", "UpdateTimeSkipSeconds": 60, "Now": "1970-01-12 00:00:00"}
    return _run(spark, {"Type": "MysqlScanInput", "Path": f"{d}/from", "Keys": ["id"]}, [{"Type": "MysqlDMLToDBChangeConverter"}], p)[0]


@_query("""WITH g AS (SELECT event_id, max(CASE WHEN event_id%4=0 THEN event_id//4 END) OVER (ORDER BY event_id) AS tx, max(CASE WHEN event_id%4=3 THEN event_id*100 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM events WHERE event_id>=0),
r AS (SELECT g.*, i FROM g, (VALUES (0),(1)) t(i) WHERE i<=event_id%2)
SELECT 'u1.'||tx||'.'||(row_number() OVER (PARTITION BY tx ORDER BY event_id, i)-1) AS id, event_id*10000000+1000000+i AS seq, pos, 'insert' AS op, event_id+i AS value FROM r""")
def log_decode_gtid(spark, sf):
    """A raw log: GTIDs, row events of one or two rows, and commits."""
    e, i = _t(spark, sf, "events").where("event_id >= 0").select("event_id"), F.col("event_id")
    row = lambda kind, n: e.select((i * 10 + n).alias("seq"), F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("server_id"), F.lit("u1").alias("server_uuid"), F.expr("event_id div 4").alias("txid"), F.lit("log.1").alias("file"), (i * 100).alias("pos"), i.alias("timestamp"), F.lit("shop").alias("database"), F.lit("t").alias("table"), F.transform(F.sequence(F.lit(0), (i % 2).cast("int")), lambda x: F.array((i + x).cast("string"))).alias("rows"), F.lit(None).cast("string").alias("query"), i.alias("e"))
    log = row("gtid", 0).where("e % 4 = 0").unionByName(row("WRITE_ROWS_EVENTv2", 1)).unionByName(row("xid", 2).where("e % 4 = 3")).drop("e")
    d = binlog.decode(log, "gtid")
    return d.select("id", "seq", F.col("pos.pos").alias("pos"), "op", F.col("new_values")[0].cast("long").alias("value"))


@_query(NET + """SELECT o_orderkey, op, op IN ('insert','update') AND (o_orderkey%10<>0 OR o_orderkey%3=0) AND NOT (op='update' AND o_orderkey%10<>0) AS has_note,
 CASE WHEN op IN ('insert','update') THEN new_status END AS status FROM merged""")
def net_change_partial_nulls(spark, sf):
    """A row that comes back with fewer columns has null in those of its deleted image that the new one lacks."""
    s = F.col("new_status")
    first = (F.col("op") == "insert") & (F.col("seq") < 10_000_000)
    image = F.when(F.col("op") == "delete", None).when(first, F.create_map(F.lit("status"), s, F.lit("note"), s)).otherwise(F.create_map(F.lit("status"), s))
    old = F.when(F.col("op") == "delete", F.create_map(F.lit("status"), F.lit("x"), F.lit("note"), F.lit("y")))
    n = N.net_changes_partial(changes(spark, sf).withColumns({"new_row": image, "old_row": old}), ["o_orderkey"])
    return n.select("o_orderkey", "op", F.coalesce(F.map_contains_key("new_row", F.lit("note")), F.lit(False)).alias("has_note"), F.try_element_at("new_row", F.lit("status")).alias("status"))

"""The registered queries of the change-data engine and their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import effective_row
from ..operators import apply as A
from ..operators import mapping as M
from ..operators import merge as N
from ..operators import position as P
from ..operators import rows as R
from ..operators.check import check_rows, recheck, report_lines
from ..sinks.tables import SnapshotTable, route_key, within_size
from ..sources import changelog, scan
from ..streaming import jobs

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """A valid change log of the orders: typed, with the seed's keys divisible by three."""
    k, step = F.col("o_orderkey"), F.col("step")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("total"))
    o = o.withColumn("step", F.explode(F.array(*map(F.lit, range(5)))))
    o = o.where(((step == 0) & (k % 3 != 0)) | ((step == 1) & (k % 2 == 0)) | ((step == 2) & (k % 5 == 0)) | ((step == 3) & (k % 10 == 0)) | ((step == 4) & (k % 20 == 0)))
    old = F.when(step.isin(0, 3), None).when(step == 1, F.col("total")).when(step == 4, F.col("total") + 3).when(k % 2 == 0, F.col("total") + 1).otherwise(F.col("total"))
    return o.select(
        (step.cast("long") * 10_000_000 + k).alias("seq"), F.concat(F.lit("shop"), (k % 4).cast("string")).alias("database"), F.concat(F.lit("orders"), (k % 8).cast("string")).alias("table"),
        F.when(step.isin(0, 3), "insert").when(step == 2, "delete").otherwise("update").alias("op"), "o_orderkey", "o_custkey", old.alias("old_total"),
        F.when(step == 2, None).otherwise(F.col("total") + step).alias("new_total"), F.when(step == 2, None).when(step.isin(1, 4), "P").otherwise(F.col("o_orderstatus")).alias("new_status"),
    )


CHANGES = """WITH steps AS (SELECT o.*, s.step FROM orders o CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS s(step)
 WHERE (s.step=0 AND o_orderkey%3<>0) OR (s.step=1 AND o_orderkey%2=0) OR (s.step=2 AND o_orderkey%5=0) OR (s.step=3 AND o_orderkey%10=0) OR (s.step=4 AND o_orderkey%20=0)),
changes AS (SELECT CAST(step AS BIGINT)*10000000+o_orderkey AS seq, 'shop'||(o_orderkey%4) AS database, 'orders'||(o_orderkey%8) AS "table",
 CASE WHEN step IN (0,3) THEN 'insert' WHEN step=2 THEN 'delete' ELSE 'update' END AS op, o_orderkey, o_custkey,
 CASE WHEN step IN (0,3) THEN NULL WHEN step=1 THEN o_totalprice WHEN step=4 THEN o_totalprice+3 WHEN o_orderkey%2=0 THEN o_totalprice+1 ELSE o_totalprice END AS old_total,
 CASE WHEN step=2 THEN NULL ELSE o_totalprice+step END AS new_total, CASE WHEN step=2 THEN NULL WHEN step IN (1,4) THEN 'P' ELSE o_orderstatus END AS new_status FROM steps)
"""
NET = CHANGES + """, net AS (SELECT o_orderkey, min_by(op,seq) AS f, max_by(op,seq) AS l, max_by(new_total,seq) AS nt, max_by(new_status,seq) AS ns, count(*) AS originals FROM changes GROUP BY 1),
merged AS (SELECT o_orderkey, CASE WHEN l='delete' AND f='insert' THEN 'noop' WHEN l='delete' THEN 'delete' WHEN f='insert' THEN 'insert' ELSE 'update' END AS op,
 CASE WHEN l<>'delete' THEN nt END AS new_total, CASE WHEN l<>'delete' THEN ns END AS new_status, originals FROM net)
"""
SEED = """, seed AS (SELECT o_orderkey, o_totalprice AS new_total, o_orderstatus AS new_status FROM orders WHERE o_orderkey%3=0)
"""
KEY, VALUES = ["o_orderkey"], ["new_total", "new_status"]


def _seed(spark, sf):
    return _t(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_totalprice").alias("new_total"), F.col("o_orderstatus").alias("new_status"))


def _net(spark, sf):
    return N.net_changes(changes(spark, sf), KEY, images=VALUES)


def _dml(spark, sf):
    """The change log in positional form."""
    s = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    key = F.col("o_orderkey").cast("string")
    return changes(spark, sf).select(
        F.col("seq").cast("string").alias("id"), "seq", F.concat_ws(".", "database", "table").alias("full_table_name"), "op",
        F.when(F.col("op") != "insert", F.array(key, s("old_total"))).alias("old_values"), F.when(F.col("op") != "delete", F.array(key, s("new_total"))).alias("new_values"))


def _maps(spark, sf):
    return R.rows_to_changes(_dml(spark, sf), ["id", "total"]).drop("id")


@_query(CHANGES + "SELECT seq, database||'.'||\"table\" AS full_table_name, op FROM changes WHERE regexp_matches(database||'.'||\"table\", '^shop[12]\\.orders[0-9]+$')")
def filter_table_regex(spark, sf):
    return R.filter_changes(_dml(spark, sf), r"^shop[12]\.orders[0-9]+$").select("seq", "full_table_name", "op")


@_query(CHANGES + "SELECT database, op, count(*) AS n FROM changes WHERE op IN ('insert','update') AND database IN ('shop1','shop2') GROUP BY 1,2")
def filter_ops(spark, sf):
    c = changes(spark, sf)
    return R.filter_changes(c, "shop[12]", ["insert", "update"], "database").groupBy("database", "op").agg(F.count("*").alias("n"))


@_query(CHANGES + "SELECT seq, CASE WHEN regexp_matches(database,'^([a-z]+)[12]$') THEN regexp_extract(database,'^([a-z]+)[12]$',1) END AS db_var, regexp_extract(\"table\",'^([a-z]+)[0-9]+$',1) AS table_var FROM changes")
def name_capture_regex(spark, sf):
    return R.catch_names(_dml(spark, sf), "db_var", "table_var", r"^([a-z]+)[12]$", r"^([a-z]+)\d+$").select("seq", "db_var", "table_var")


@_query(CHANGES + "SELECT seq, database AS db_var, \"table\" AS table_var FROM changes")
def name_capture_plain(spark, sf):
    return R.catch_names(_dml(spark, sf), "db_var", "table_var").select("seq", "db_var", "table_var")


_IMAGES = "CASE WHEN op<>'insert' THEN CAST(CAST(old_total AS DECIMAL(18,2)) AS VARCHAR) END AS old_total, CASE WHEN op<>'delete' THEN CAST(CAST(new_total AS DECIMAL(18,2)) AS VARCHAR) END AS new_total"


@_query(CHANGES + f"SELECT seq, database, \"table\", op, {_IMAGES} FROM changes")
def convert_positional_rows(spark, sf):
    return _maps(spark, sf).select("seq", "database", "table", "op", F.col("old_row")["total"].alias("old_total"), F.col("new_row")["total"].alias("new_total"))


@_query(CHANGES + "SELECT seq, CAST(o_orderkey AS VARCHAR) AS partition_key FROM changes")
def column_value_variable(spark, sf):
    d = R.catch_names(_dml(spark, sf), table_var="logical", table_pattern=r"^([a-z]+)\d+$")
    return R.column_value(R.rows_to_changes(d, ["id", "total"]), "logical", {"orders": "id"}, "partition_key").select("seq", "partition_key")


@_query(CHANGES + "SELECT seq, CASE database WHEN 'shop0' THEN 'topic_a' WHEN 'shop1' THEN 'topic_b' ELSE '' END AS topic FROM changes")
def value_mapper(spark, sf):
    d = R.catch_names(_dml(spark, sf), db_var="v")
    return R.map_value(d, "v", {"shop0": "topic_a", "shop1": "topic_b"}, "topic").select("seq", "topic")


def _mapped(df, m, db_var=None, table_var=None):
    return M.map_changes(df, M.parse_mappings(m), db_var, table_var)


@_query(CHANGES + "SELECT seq, CASE database WHEN 'shop1' THEN 'store_one' ELSE database END AS database FROM changes")
def map_db_exact(spark, sf):
    return _mapped(_maps(spark, sf), [{"Source": {"DB": "shop1"}, "Target": {"DB": "store_one"}}]).select("seq", "database")


@_query(CHANGES + "SELECT seq, replace(database,'shop','store') AS database, replace(\"table\",'orders','sales') AS \"table\" FROM changes")
def map_db_logical(spark, sf):
    d = _maps(spark, sf).withColumns({"db_var": F.lit("shop"), "table_var": F.lit("orders")})
    m = [{"Source": {"DB": "shop", "Tables": [{"Table": "orders"}]}, "Target": {"DB": "store", "Tables": [{"Table": "sales"}]}}]
    return _mapped(d, m, "db_var", "table_var").select("seq", "database", "table")


@_query(CHANGES + "SELECT seq, CASE WHEN database='shop1' THEN 's1' ELSE database END AS database, CASE WHEN database='shop1' AND \"table\"='orders5' THEN 'o5' ELSE \"table\" END AS \"table\" FROM changes")
def map_table(spark, sf):
    m = [{"Source": {"DB": "shop1", "Tables": [{"Table": "orders5"}]}, "Target": {"DB": "s1", "Tables": [{"Table": "o5"}]}}]
    return _mapped(_maps(spark, sf), m).select("seq", "database", "table")


@_query(CHANGES + "SELECT seq, CAST(o_orderkey AS VARCHAR) AS swapped FROM changes WHERE database='shop1' AND \"table\"='orders1' AND op<>'delete'")
def map_columns(spark, sf):
    t = [{"Table": "orders1", "Columns": ["id", "total"]}], [{"Table": "orders1", "Columns": ["total", "id"]}]
    d = _mapped(_maps(spark, sf), [{"Source": {"DB": "shop1", "Tables": t[0]}, "Target": {"DB": "shop1", "Tables": t[1]}}])
    return d.where("database = 'shop1' and table = 'orders1' and op <> 'delete'").select("seq", F.col("new_row")["total"].alias("swapped"))


_OLD = {("insert", "update"): "new", ("insert", "delete"): "new", ("update", "insert"): None, ("update", "delete"): "new", ("delete", "insert"): None, ("delete", "update"): "old"}
_NEW = {("insert", "update"): "new", ("insert", "delete"): None, ("update", "insert"): "new", ("update", "delete"): None, ("delete", "insert"): "old", ("delete", "update"): "old"}


def _image_sql(x):
    return "CAST(NULL AS VARCHAR)" if x is None else f"CAST(CAST({x}_total AS DECIMAL(18,2)) AS VARCHAR)"


def _action(a, b):
    sql = CHANGES + f"SELECT seq, '{b}' AS op, {_image_sql(_OLD[a, b])} AS old_total, {_image_sql(_NEW[a, b])} AS new_total FROM changes WHERE op='{a}' AND database='shop0' AND \"table\"='orders4'"

    def run(spark, sf):
        t = [{"Table": "orders4", "Actions": [a]}], [{"Table": "orders4", "Actions": [b]}]
        d = R.filter_changes(_maps(spark, sf), ops=[a]).where("database = 'shop0' and table = 'orders4'")
        d = _mapped(d, [{"Source": {"DB": "shop0", "Tables": t[0]}, "Target": {"DB": "shop0", "Tables": t[1]}}])
        return d.select("seq", "op", F.col("old_row")["total"].alias("old_total"), F.col("new_row")["total"].alias("new_total"))

    run.__name__ = f"map_actions_{a}_to_{b}"
    _query(sql)(run)


for _a, _b in _OLD:
    _action(_a, _b)


@_query(CHANGES + f"SELECT seq, database, op, {_IMAGES} FROM changes")
def json_roundtrip(spark, sf):
    d = R.from_json(R.to_json(_maps(spark, sf)).select("seq", "value"))
    return d.select("seq", "database", "op", F.col("old_row")["total"].alias("old_total"), F.col("new_row")["total"].alias("new_total"))


@_query("SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def json_field_extract(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query(CHANGES + "SELECT seq, CAST(CAST(CASE WHEN op='delete' THEN old_total ELSE new_total END AS DECIMAL(18,2)) AS VARCHAR) AS total FROM changes")
def effective_image(spark, sf):
    return _maps(spark, sf).select("seq", effective_row()["total"].alias("total"))


def _log(spark, sf):
    """The events as a replication log: server, transaction of four events, position and a commit mark."""
    e, i = _t(spark, sf, "events"), F.col("event_id")
    return e.select("event_id", (F.col("user_id") % 3).alias("server"), F.floor(i / 4).cast("long").alias("tx"), (i * 100 + 4).alias("pos"), (i % 4 == 3).alias("committed"))


_LOG = "WITH log AS (SELECT event_id, user_id%3 AS server, CAST(floor(event_id/4) AS BIGINT) AS tx, event_id*100+4 AS pos, event_id%4=3 AS committed FROM events)\n"


@_query(_LOG + "SELECT event_id, 'u'||server||'.'||tx||'.'||(row_number() OVER (PARTITION BY server,tx ORDER BY event_id)-1) AS id FROM log")
def event_id_gtid(spark, sf):
    d = _log(spark, sf).withColumn("o", P.transaction_offset(["server", "tx"], "event_id"))
    return d.select("event_id", P.event_id("gtid", F.concat(F.lit("u"), F.col("server").cast("string")), "tx", "o").alias("id"))


@_query(_LOG + "SELECT event_id, server||'.binlog.'||tx||'.'||pos||'.'||(event_id%4) AS id FROM log")
def event_id_filepos(spark, sf):
    d = _log(spark, sf)
    return d.select("event_id", P.event_id("filepos", "server", F.concat(F.lit("binlog."), F.col("tx").cast("string")), "pos", F.col("event_id") % 4).alias("id"))


@_query(_LOG + "SELECT event_id, row_number() OVER (PARTITION BY server,tx ORDER BY event_id)-1 AS tx_offset FROM log")
def txn_offset(spark, sf):
    return _log(spark, sf).select("event_id", P.transaction_offset(["server", "tx"], "event_id").alias("tx_offset"))


@_query(_LOG + "SELECT event_id, max(CASE WHEN committed THEN pos END) OVER (PARTITION BY server ORDER BY event_id) AS committed_pos FROM log")
def last_committed_pos(spark, sf):
    return P.last_committed(_log(spark, sf), "pos", "committed", ["server"], "event_id").select("event_id", "committed_pos")


@_query("SELECT o_orderkey, i AS row_index, o_orderkey+2*i AS before_value, o_orderkey+2*i+1 AS after_value FROM orders, (VALUES (0),(1)) t(i) WHERE i < floor((2+o_orderkey%4)/2)")
def update_pair_explode(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4 + 1).cast("int")), lambda i: F.array(F.col("o_orderkey") + i))
    d = _t(spark, sf, "orders").select("o_orderkey", rows.alias("rows"))
    return P.explode_row_pairs(d).select("o_orderkey", "row_index", F.col("old_values")[0].alias("before_value"), F.col("new_values")[0].alias("after_value"))


@_query("SELECT event_id, CASE event_id%3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op FROM events")
def event_operation(spark, sf):
    kind = F.element_at(F.array(F.lit("WRITE_ROWS_EVENTv2"), F.lit("UPDATE_ROWS_EVENTv1"), F.lit("DELETE_ROWS_EVENTv0")), (F.col("event_id") % 3 + 1).cast("int"))
    return _t(spark, sf, "events").select("event_id", changelog.event_operation(kind).alias("op"))


def _gtids(spark, sf):
    return _t(spark, sf, "events").where("event_id % 10 < 7").select(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("uuid"), F.col("event_id").alias("txid"))


_GAPS = "WITH d AS (SELECT DISTINCT 'u'||(user_id%3) AS uuid, event_id AS txid FROM events WHERE event_id%10<7), g AS (SELECT *, txid-row_number() OVER (PARTITION BY uuid ORDER BY txid) AS k FROM d), r AS (SELECT uuid, min(txid) AS lo, max(txid) AS hi, count(*) AS n FROM g GROUP BY uuid,k)\n"


@_query(_GAPS + "SELECT uuid, lo, hi, n FROM r")
def gtid_gaps(spark, sf):
    return P.intervals(_gtids(spark, sf))


@_query(_GAPS + "SELECT uuid, uuid||':'||string_agg(CASE WHEN lo=hi THEN CAST(lo AS VARCHAR) ELSE lo||'-'||hi END, ':' ORDER BY lo) AS gtid_set FROM r GROUP BY uuid")
def gtid_set_union(spark, sf):
    own = P.intervals(_gtids(spark, sf)).select("uuid", "lo", "hi")
    return P.set_text(P.merge_intervals(own.unionByName(own.where("lo % 2 = 0"))))


@_query("SELECT 'insert' AS op, o_orderkey AS scan_key, o_totalprice AS total FROM orders")
def table_scan_insert(spark, sf):
    return scan.as_inserts(_t(spark, sf, "orders"), "shop", "orders", KEY).select("op", F.col("scan_pos.o_orderkey").alias("scan_key"), F.col("new_row.o_totalprice").alias("total"))


@_query("SELECT o_custkey, o_orderkey FROM orders ORDER BY 1,2 LIMIT 101")
def keyset_page(spark, sf):
    return scan.key_page(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], 100)


@_query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey>100 OR (o_custkey=100 AND o_orderkey>=50) ORDER BY 1,2 LIMIT 101")
def keyset_resume(spark, sf):
    return scan.key_page(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], 100, [100, 50])


@_query("SELECT 'shop' AS database, 'orders'||(o_orderkey%4) AS \"table\", count(*) AS total_count, max(CASE WHEN o_orderkey%4<>1 OR o_custkey<50 THEN o_orderkey END) AS last_key, count(CASE WHEN o_orderkey%4<>1 OR o_custkey<50 THEN 1 END) AS finished_count, count(CASE WHEN o_orderkey%4<>1 OR o_custkey<50 THEN 1 END)>=count(*) AS done FROM orders GROUP BY 2")
def scan_progress(spark, sf):
    o = _t(spark, sf, "orders").select(F.lit("shop").alias("database"), F.concat(F.lit("orders"), (F.col("o_orderkey") % 4).cast("string")).alias("table"), F.struct("o_orderkey").alias("scan_pos"), "o_custkey", "o_orderkey")
    p = scan.progress(o.where("o_orderkey % 4 <> 1 or o_custkey < 50"), o.groupBy("database", "table").agg(F.count("*").alias("total_count")))
    return p.select("database", "table", "total_count", F.col("last_pos.o_orderkey").alias("last_key"), "finished_count", "done")


@_query(NET + "SELECT * FROM merged")
def net_change(spark, sf):
    return _net(spark, sf)


@_query(CHANGES + ", more AS (SELECT * FROM (SELECT seq, op, o_orderkey FROM changes UNION ALL SELECT 90000000+o_orderkey, 'insert', o_orderkey FROM orders WHERE o_orderkey%50=1)), p AS (SELECT *, lag(op) OVER (PARTITION BY o_orderkey ORDER BY seq) AS previous_op FROM more) SELECT o_orderkey, seq, op, previous_op FROM p WHERE (op='insert' AND previous_op<>'delete') OR (op='update' AND previous_op='delete')")
def net_change_violations(spark, sf):
    c = changes(spark, sf).select("seq", "op", "o_orderkey")
    more = _t(spark, sf, "orders").where("o_orderkey % 50 = 1").select((F.col("o_orderkey") + 90_000_000).alias("seq"), F.lit("insert").alias("op"), "o_orderkey")
    return N.violations(c.unionByName(more), KEY).select("o_orderkey", "seq", "op", "previous_op")


@_query(NET + "SELECT o_orderkey, originals FROM merged WHERE op='noop'")
def net_change_cancelled(spark, sf):
    return _net(spark, sf).where("op = 'noop'").select("o_orderkey", "originals")


@_query(NET + ", s AS (SELECT o_orderkey, max(CASE WHEN op IN ('insert','delete') THEN seq END) AS st FROM changes GROUP BY 1), l AS (SELECT c.o_orderkey, max(CASE WHEN op='update' AND seq%10000000%4<>0 THEN seq END) AS u, max(CASE WHEN op<>'delete' AND (op='insert' OR o_orderkey%4=0) THEN seq END) AS a FROM changes c JOIN s USING (o_orderkey) WHERE seq>=coalesce(st,seq) GROUP BY 1) SELECT m.o_orderkey, m.op, x.new_status AS status, y.new_status AS note FROM merged m LEFT JOIN l USING (o_orderkey) LEFT JOIN changes x ON x.seq=(CASE WHEN m.op IN ('insert','update') THEN greatest(coalesce(l.u,-1),coalesce(l.a,-1)) END) LEFT JOIN changes y ON y.seq=(CASE WHEN m.op IN ('insert','update') THEN l.a END)")
def net_change_partial(spark, sf):
    # updates of keys that 4 does not divide write one column only
    s, full = F.col("new_status"), (F.col("op") == "insert") | (F.col("o_orderkey") % 4 == 0)
    image = F.when(F.col("op") == "delete", None).when(full, F.create_map(F.lit("status"), s, F.lit("note"), s)).otherwise(F.create_map(F.lit("status"), s))
    n = N.net_changes_partial(changes(spark, sf).withColumn("new_row", image), KEY)
    return n.select("o_orderkey", "op", F.try_element_at("new_row", F.lit("status")).alias("status"), F.try_element_at("new_row", F.lit("note")).alias("note"))


@_query(NET + "SELECT op, count(*) AS n, sum(originals) AS originals FROM merged WHERE op<>'noop' GROUP BY 1")
def split_by_operation(spark, sf):
    parts = [d.agg(F.count("*").alias("n"), F.sum("originals").alias("originals")).withColumn("op", F.lit(op)) for op, d in N.by_operation(_net(spark, sf)).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("n > 0")


_WINS = SEED + "SELECT coalesce(s.o_orderkey,m.o_orderkey) AS o_orderkey, CASE WHEN m.op IN ('insert','update') THEN m.new_total ELSE s.new_total END AS new_total, CASE WHEN m.op IN ('insert','update') THEN m.new_status ELSE s.new_status END AS new_status FROM seed s FULL JOIN merged m USING (o_orderkey) WHERE coalesce(m.op,'none') NOT IN ('delete','noop')"


@_query(NET + _WINS)
def apply_net(spark, sf):
    return A.apply_net(_seed(spark, sf), _net(spark, sf), KEY)


@_query(NET + SEED + "SELECT coalesce(s.o_orderkey,m.o_orderkey) AS o_orderkey, CASE WHEN m.op='update' OR s.o_orderkey IS NULL THEN m.new_total ELSE s.new_total END AS new_total, CASE WHEN m.op='update' OR s.o_orderkey IS NULL THEN m.new_status ELSE s.new_status END AS new_status FROM seed s FULL JOIN (SELECT * FROM merged WHERE op<>'noop') m USING (o_orderkey) WHERE coalesce(m.op,'none')<>'delete' AND NOT (coalesce(m.op,'none')='update' AND s.o_orderkey IS NULL)")
def apply_net_ignore(spark, sf):
    return A.apply_net(_seed(spark, sf), _net(spark, sf), KEY, on_conflict="ignore")


@_query(NET + _WINS)
def apply_sequential(spark, sf):
    return A.apply_sequential(_seed(spark, sf), changes(spark, sf), KEY)


@_query(NET + _WINS)
def apply_replay_converges(spark, sf):
    once = A.apply_net(_seed(spark, sf), _net(spark, sf), KEY)
    return A.apply_net(once, _net(spark, sf), KEY)


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE NOT (l_orderkey%7=0 AND l_linenumber=1) GROUP BY 1,2")
def apply_composite_pk_delete(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    left = A.delete_keys(li, li.where("l_orderkey % 7 = 0 and l_linenumber = 1"), ["l_orderkey", "l_linenumber"])
    return left.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@_query("SELECT CASE WHEN o_orderkey%10=0 THEN -o_orderkey ELSE o_orderkey END AS k, o_totalprice AS total FROM orders")
def apply_pk_change(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    c = o.where("k % 10 = 0").select(F.col("k").alias("seq"), F.lit("update").alias("op"), F.struct("k", "total").alias("old_row"), F.struct((-F.col("k")).alias("k"), "total").alias("new_row"))
    c = N.split_key_changes(c, ["k"])
    return A.apply_changes(o, c.select("seq", "op", effective_row()["k"].alias("k"), effective_row()["total"].alias("total")), ["k"])


def _pair(spark, sf):
    status = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus"))
    s = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", status.alias("o_orderstatus"), "o_orderdate")
    t = s.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))
    return s, t.unionByName(s.limit(0).unionByName(spark.range(1, 6).select((-F.col("id")).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"), F.lit("F").alias("o_orderstatus"), F.lit(None).cast("timestamp_ntz").alias("o_orderdate"))))


@_query("SELECT o_orderkey, 'row_miss' AS err FROM orders WHERE o_orderkey%7=0")
def check_row_miss(spark, sf):
    return check_rows(*_pair(spark, sf), KEY).where("err = 'row_miss'").select("o_orderkey", "err")


@_query("SELECT o_orderkey, 'row_diff' AS err, o_totalprice AS expected, o_totalprice+1 AS found FROM orders WHERE o_orderkey%7<>0 AND o_orderkey%11=0")
def check_row_diff(spark, sf):
    return check_rows(*_pair(spark, sf), KEY).where("err = 'row_diff'").select("o_orderkey", "err", F.col("expected.o_totalprice").alias("expected"), F.col("real.o_totalprice").alias("found"))


@_query("SELECT 'err:row_miss db:shop table:orders  - expected:o_orderkey:'||o_orderkey||' o_orderstatus:'||CASE WHEN o_orderkey%13=0 THEN 'null' ELSE o_orderstatus END AS line FROM orders WHERE o_orderkey%7=0")
def check_report(spark, sf):
    s, t = _pair(spark, sf)
    return report_lines(check_rows(s.select("o_orderkey", "o_orderstatus"), t.select("o_orderkey", "o_orderstatus"), KEY), "shop", "orders")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey%7<>0 AND o_orderkey%11=0 AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 60 SECOND")
def check_recheck_diff(spark, sf):
    s, t = _pair(spark, sf)
    return recheck(check_rows(s, t, KEY), s, KEY, "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"), 60).where("err = 'row_diff'").select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey%7=0 AND o_orderkey%2=0")
def check_recheck_miss(spark, sf):
    s, t = _pair(spark, sf)
    return recheck(check_rows(s, t, KEY), s.where("o_orderkey % 2 = 0"), KEY, "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz")).where("err = 'row_miss'").select("o_orderkey")


_QPS = "SELECT time_bucket(INTERVAL 10 SECOND, ts, TIMESTAMP '1970-01-01') AS w, count(*) AS n FROM events GROUP BY 1"


@_query(f"SELECT epoch(w)::BIGINT AS window_start, n//10 AS qps, n FROM ({_QPS})")
def qps_tumbling(spark, sf):
    return jobs.rate(_t(spark, sf, "events"), "ts").withColumn("window_start", F.unix_timestamp("window_start"))


@_query(CHANGES + "SELECT database, \"table\", 2000000000-max(1000000000+seq) AS delay_sec FROM changes GROUP BY 1,2")
def delay_by_table(spark, sf):
    return jobs.delay(changes(spark, sf).withColumn("db_time", F.col("seq") + 1_000_000_000), 2_000_000_000)


@_query(CHANGES + "SELECT CASE database WHEN 'shop0' THEN 'a' ELSE 'b' END AS topic, CAST(o_orderkey AS VARCHAR) AS key, CAST(seq AS VARCHAR) AS value FROM changes")
def route_kafka_key_topic(spark, sf):
    c = changes(spark, sf).select(F.when(F.col("database") == "shop0", "a").otherwise("b").alias("t"), "o_orderkey", F.col("seq").cast("string").alias("value"))
    return route_key(c, "value", topic_var="t", key_var="o_orderkey")


@_query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 2000")
def huge_message_filter(spark, sf):
    return within_size(_t(spark, sf, "documents"), "text", 2000).select("doc_id")


@_query("SELECT event_id, event_type FROM events WHERE event_id=138")
def debug_filter(spark, sf):
    return _t(spark, sf, "events").where("event_id = 138").select("event_id", "event_type")


@_query("SELECT 'ev'||'.'||(event_id%4)||'.'||event_id AS id, event_id FROM events")
def kafka_record_id(spark, sf):
    e = _t(spark, sf, "events").select(F.lit("ev").alias("topic"), (F.col("event_id") % 4).alias("partition"), F.col("event_id").alias("offset"), "event_id")
    return changelog.with_record_id(e).select("id", "event_id")


def _work(spark: SparkSession) -> str:
    """A folder of a stream's own: beneath spark.checkpoint.dir, or a local one where that is unset."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base}/stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="changeloom-")


@_query(NET + _WINS)
def stream_apply(spark, sf):
    d = _work(spark)
    n = changelog.write_log(changes(spark, sf), f"{d}/log")
    t = SnapshotTable(spark, f"{d}/target")
    t.write(_seed(spark, sf), 0)
    # files come by the time of their writing, not by seq: fewer batches than a compaction takes are put in order by seq
    log = changelog.stream_changelog(spark, f"{d}/log", spark.read.parquet(f"{d}/log").schema, max_files=max(100, -(-n // 7)))
    log.writeStream.option("checkpointLocation", f"{d}/checkpoint").trigger(availableNow=True).foreachBatch(jobs.apply_batches(t, KEY)).start().awaitTermination()
    return t.read()


@_query(f"SELECT epoch(w)::BIGINT AS window_start, n//10 AS qps, n FROM ({_QPS})")
def stream_qps(spark, sf):
    d = _work(spark)
    _t(spark, sf, "events").write.parquet(f"{d}/in")
    s = spark.readStream.schema(spark.read.parquet(f"{d}/in").schema).parquet(f"{d}/in")
    g = jobs.rate(s, "ts")

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{d}/out")

    g.writeStream.outputMode("complete").option("checkpointLocation", f"{d}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{d}/out").withColumn("window_start", F.unix_timestamp("window_start"))


def queries() -> dict:
    from . import task_queries  # noqa: F401 - registers its own

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)

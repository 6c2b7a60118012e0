"""Golden cases, properties, tasks and streams of the change-data engine."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.model import ChangeError, SchemaStore, column_type, primary_key, table_schema
from changeloom.operators import apply as A
from changeloom.operators import merge as N
from changeloom.operators import position as P
from changeloom.operators import rows as R
from changeloom.operators.mapping import map_changes, parse_mappings
from changeloom.plans import catalogue, tasks
from changeloom.sinks.jdbc import JdbcTarget
from changeloom.sinks.tables import Folder, SnapshotTable, route_key, within_size
from changeloom.sources import binlog, changelog, scan
from changeloom.streaming import jobs
from changeloom.streaming.metrics import Gauges

DML = "id string, seq long, full_table_name string, op string, old_values array<string>, new_values array<string>, db_time long, event_time long"


def dml(spark, *rows):
    return spark.createDataFrame([(str(i), i, n, op, old, new, 1, 2) for i, (n, op, old, new) in enumerate(rows)], DML)


def test_filter(spark):
    d = dml(spark, ("eu_shop3.bill_07", "insert", None, None), ("eu_shop3.bill_", "update", None, None), ("eu_shop3.bill_08", "delete", None, None), ("us_shop3.bill_07", "insert", None, None))
    assert [r.seq for r in R.filter_changes(d, r"^eu_.*\.bill_\d{2}$", ["insert", "update"]).collect()] == [0]
    assert [r.seq for r in R.filter_changes(d, "shop3[.]bill_0").orderBy("seq").collect()] == [0, 2, 3]  # found anywhere
    assert R.filter_changes(d).count() == 4 and R.filter_changes(d, ops=["delete"]).count() == 1
    with pytest.raises(ChangeError):
        R.filter_changes(d, ops=["merge"])
    assert R._prefix("^shop[12]") == "shop" and R._prefix("^ab*") == "a" and R._prefix("^a|b") is None and R._prefix("ab") is None and R._prefix(r"^a\.b") == "a.b"


def test_names(spark):
    d = dml(spark, ("ledger_2024.entry_q3", "insert", None, None))
    r = R.catch_names(d, "d", "t", r"_(\d+)$", r"^(.*)_q(\d)$").first()
    assert (r.d, r.t) == ("2024", "entry")  # group 1, wherever it stands
    r = R.catch_names(d, "d", "t").first()
    assert (r.d, r.t) == ("ledger_2024", "entry_q3")
    assert R.catch_names(d, "d", db_pattern="^nope(x)").first().d is None and R.catch_names(d, "d", db_pattern="^ledger").first().d is None
    with pytest.raises(ChangeError):
        R.catch_names(d)
    with pytest.raises(ChangeError):
        R.catch_names(d, "d", table_pattern="x")
    for name in ("a.b.c", "a"):
        with pytest.raises(PySparkException):
            R.catch_names(dml(spark, (name, "insert", None, None)), "d").collect()


def test_convert(spark):
    d = dml(spark, ("inv.part", "update", ["7", "bolt", None], ["7", "nut", "9"]), ("inv.part", "insert", [], ["1", None, "x"]), ("inv.part", "delete", ["2", "cog", ""], None))
    a, b, c = R.rows_to_changes(d, ["no", "kind", "bin"]).orderBy("seq").collect()
    assert (a.database, a.table, a.old_row, a.new_row) == ("inv", "part", {"no": "7", "kind": "bolt", "bin": None}, {"no": "7", "kind": "nut", "bin": "9"})
    assert b.old_row is None and b.new_row == {"no": "1", "kind": None, "bin": "x"} and c.new_row is None and c.old_row["bin"] == ""
    own = F.when(F.col("op") != "delete", F.array(*map(F.lit, "xyz")))
    assert R.rows_to_changes(d.where("op = 'insert'"), own).first().new_row == {"x": "1", "y": None, "z": "x"}
    for columns in (["no"], own):  # a wrong number of values, and no schema
        with pytest.raises(PySparkException):
            R.rows_to_changes(d, columns).collect()
    with pytest.raises(ChangeError):
        R.rows_to_changes(d, [])


def _map_config(source: dict, target: dict) -> list[dict]:
    return [{"Source": source, "Target": target}]


CH = "database string, table string, op string, old_row map<string,string>, new_row map<string,string>, v string, w string"


def test_mapping(spark):
    m = _map_config({"DB": "wh", "Tables": [{"Table": "stock", "Columns": ["qty", "place"], "Actions": ["delete"]}, {"Table": "lot"}]}, {"DB": "depot", "Tables": [{"Table": "goods", "Columns": ["place", "qty"], "Actions": ["insert"]}, {"Table": "batch"}]})
    d = spark.createDataFrame([("wh_07", "stock_wh", "delete", {"no": "5", "qty": "2", "place": "A"}, None, "wh", "stock"), ("wh_07", "lot_lot", "update", {"no": "1"}, {"no": "1"}, "wh", "lot"), ("wh_07", "other", "insert", None, {"no": "9"}, "wh", "other")], CH)
    a, b, c = map_changes(d, parse_mappings(m), "v", "w").collect()
    assert (a.database, a.table, a.op, a.old_row, a.new_row) == ("depot_07", "goods_wh", "insert", None, {"no": "5", "place": "2", "qty": "A"})
    assert (b.database, b.table, b.op) == ("depot_07", "batch_lot", "update")  # the first occurrence only
    assert (c.database, c.table, c.new_row) == ("depot_07", "other", {"no": "9"})
    d = spark.createDataFrame([("wh", "lot", "delete", {"no": "2"}, None, None, None), ("wh_07", "lot", "delete", {"no": "2"}, None, None, None)], CH)
    a, b = map_changes(d, parse_mappings(m)).collect()
    assert (a.database, a.table, a.old_row, a.new_row) == ("depot", "batch", {"no": "2"}, None)
    assert (b.database, b.table) == ("wh_07", "lot")
    with pytest.raises(PySparkException):
        map_changes(d, parse_mappings(m), "v").collect()
    clash = spark.createDataFrame([("x", "t", "insert", None, {"a": "1", "b": "2"}, None, None)], CH)
    with pytest.raises(PySparkException):
        map_changes(clash, parse_mappings(_map_config({"DB": "x", "Tables": [{"Table": "t", "Columns": ["a"]}]}, {"DB": "x", "Tables": [{"Table": "t", "Columns": ["b"]}]}))).collect()
    for bad in ([], [{"Source": {"DB": "a"}}], _map_config({"DB": "a", "Tables": [{"Table": "t"}]}, {"DB": "b", "Tables": []})):
        with pytest.raises(ChangeError):
            parse_mappings(bad)


def test_values(spark):
    d = spark.createDataFrame([("insert", None, {"id": "7"}, "t"), ("delete", {"id": "8"}, None, "t")], "op string, old_row map<string,string>, new_row map<string,string>, tv string")
    assert [r.k for r in R.column_value(d, "tv", {"t": "id"}, "k").collect()] == ["7", "8"]
    assert [r.k for r in R.column_value(d, "tv", {"t": "none"}, "k").collect()] == [None, None]
    assert [r.k for r in R.map_value(d, "tv", {"u": "x"}, "k").collect()] == ["", ""]
    with pytest.raises(PySparkException):
        R.column_value(d, "tv", {"u": "id"}, "k").collect()
    with pytest.raises(PySparkException):
        R.map_value(d.withColumn("tv", F.lit(None).cast("string")), "tv", {"u": "x"}, "k").collect()


def test_json(spark):
    d = spark.createDataFrame([('{"ID":"a","Operation":"insert","NewRow":{"id":9007199254740993}}',)], "value string")
    r = R.from_json(d, row=T.StructType([T.StructField("id", T.LongType())])).first()
    assert (r.id, r.new_row.id, r.old_row) == ("a", 9007199254740993, None)
    assert '"OldRow":null' in R.to_json(d.select(F.lit("a").alias("id"))).first().value
    with pytest.raises(Exception, match="Malformed"):
        R.from_json(spark.createDataFrame([("{",)], "value string")).collect()  # raised by the JVM


def fold(ops):
    """The ordered fold of a key's events; None if the sequence cannot be."""
    state = None
    for o in ops:
        if state is None:
            state, in_db = o, o != "insert"
        elif o == "insert" and state != "delete" or o == "update" and state == "delete":
            return None
        elif o == "delete":
            state = "delete"
        elif o == "insert":
            state = "update" if in_db else "insert"
    return "noop" if state == "delete" and not in_db else state


def test_net_change_is_the_fold(spark):
    seqs = [s for n in range(1, 6) for s in itertools.product(["insert", "update", "delete"], repeat=n)]
    rows = [(k, i, o, i) for k, s in enumerate(seqs) for i, o in enumerate(s)]
    d = spark.createDataFrame(rows, "k int, seq int, op string, v int")
    bad = {r.k for r in N.violations(d, ["k"]).collect()}
    assert bad == {k for k, s in enumerate(seqs) if fold(s) is None}
    good = d.where(~F.col("k").isin(sorted(bad)))
    net = {r.k: r for r in N.net_changes(good, ["k"], images=["v"]).collect()}
    for k, s in enumerate(seqs):
        if k not in bad:
            assert (net[k].op, net[k].originals) == (fold(s), len(s))
            assert net[k].v == (len(s) - 1 if net[k].op in ("insert", "update") else None)
    with pytest.raises(PySparkException):
        N.net_changes(d, ["k"], images=["v"]).collect()


def test_apply_agrees_and_replays(spark):
    rng, log, state, seq = random.Random(4), [], {k: 0 for k in range(0, 60, 2)}, 0
    target = spark.createDataFrame(list(state.items()), "k int, v int")
    for _ in range(600):
        seq, k = seq + 1, rng.randrange(60)
        op = rng.choice(["update", "delete"]) if k in state else "insert"
        log.append((k, seq, op, None if op == "delete" else seq))
        state.pop(k) if op == "delete" else state.update({k: seq})
    d = spark.createDataFrame(log, "k int, seq int, op string, v int")
    get = lambda df: {r.k: r.v for r in df.collect()}
    assert get(A.apply_changes(target, d, ["k"])) == state == get(A.apply_sequential(target, d, ["k"]))
    part = A.apply_changes(target, d.where("seq <= 350"), ["k"])
    assert get(A.apply_changes(part, d.where("seq > 200"), ["k"], on_invalid="ignore")) == state
    assert get(A.apply_net(target, N.net_changes(d.limit(0), ["k"], images=["v"]), ["k"])) == get(target)


def test_types():
    assert column_type("bigint unsigned")[0] == T.DecimalType(20, 0) and column_type("decimal(10,2)")[0] == T.DecimalType(10, 2)
    assert column_type("TINYINT(1) UNSIGNED")[0] == T.ShortType() and column_type("geometry")[0] == T.StringType() and column_type("bit(1)")[0] == T.BooleanType()
    s = table_schema([{"name": "id", "type": "int", "key": "PRI", "nullable": False}, {"name": "c", "type": "char(120)", "default": ""}])
    assert primary_key(s) == ["id"] and s["c"].metadata["length"] == 120
    with pytest.raises(ChangeError):
        primary_key(table_schema([{"name": "c", "type": "text"}]))


def test_positions(spark):
    s = spark.range(1).select(F.explode(P.parse_set(F.lit("u:1-3:5, v:7"))).alias("x")).select("x.*")
    assert sorted(map(tuple, s.collect())) == [("u", 1, 3), ("u", 5, 5), ("v", 7, 7)]
    merged = P.merge_intervals(s.unionByName(spark.createDataFrame([("u", 4, 4), ("v", 1, 9)], "uuid string, lo long, hi long")))
    assert sorted(r.gtid_set for r in P.set_text(merged).collect()) == ["u:1-5", "v:1-9"]
    assert P.contains(merged, spark.createDataFrame([("u", 5), ("u", 6)], "uuid string, txid long")).count() == 1
    e = spark.createDataFrame([("WRITE_ROWS_EVENTv2", [["1"], ["2"]]), ("UPDATE_ROWS_EVENTv1", [["1"], ["3"], ["9"]]), ("DELETE_ROWS_EVENTv0", [["2"]])], "kind string, rows array<array<string>>")
    got = sorted((r.op, r.row_index, r.old_values, r.new_values) for r in changelog.explode_events(e).collect())
    assert got == [("delete", 0, ["2"], None), ("insert", 0, None, ["1"]), ("insert", 1, None, ["2"]), ("update", 0, ["1"], ["3"])]


def test_keyset_reaches_the_scan(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    plan = scan.key_page(o, ["o_custkey", "o_orderkey"], 10, [5, 5])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(o_custkey,5)" in plan
    seen, bound = [], None
    while True:
        page = scan.key_page(o.where("o_custkey < 30").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], 7, bound).collect()
        seen += page[:7]
        if len(page) < 8:
            break
        bound = list(page[7])
    assert len(seen) == len(set(seen)) == o.where("o_custkey < 30").count()
    with pytest.raises(ChangeError):
        scan.key_page(o, [], 1)


def test_messages(spark):
    d = spark.createDataFrame([("t", 1, "x" * 5), (None, 2, "y")], "t string, k long, value string")
    with pytest.raises(PySparkException):
        route_key(d, topic_var="t").collect()
    assert route_key(d, topic="q", key_var="k").first().key == "1" and within_size(d, most=3).count() == 1
    with pytest.raises(PySparkException):
        within_size(d, most=3, block=True).collect()


SCHEMA = [{"name": "k", "type": "int", "key": "PRI"}, {"name": "v", "type": "varchar(9)"}]


def task(out, log, **more):
    return {"Task": {"ID": "t", "Pipeline": {"ID": "p", "Type": "DisruptorPipeline", "Input": {"Type": "MysqlBinlogInput", "Path": log}, "Processors": [
        {"Type": "MysqlDMLFilter", "FullTableNamePattern": "^shop"}, {"Type": "MysqlDMLToDBChangeConverter", "Columns": ["k", "v"]}], "Output": out}} | more}


def put_log(spark, path, *events):
    dml(spark, *events).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is not None, x) for x in r])


def test_tasks(spark, tmp_path):
    log, to = str(tmp_path / "log"), Folder(spark, str(tmp_path / "t"))
    put_log(spark, log, ("shop.a", "insert", None, ["3", "c"]), ("shop.a", "update", ["1", "a"], ["5", "z"]), ("shop.a", "delete", ["2", "b"], None), ("other.a", "insert", None, ["9", "q"]), ("shop.b", "insert", None, ["3", "own"]))
    to.snapshot("shop", "a").write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    out = {"Type": "MysqlBatchOutput", "Path": to.path, "Keys": {"shop.*": ["k"]}}
    with pytest.raises(ChangeError, match="no schema for shop.b"):
        tasks.load_task(task(out, log), spark).run()
    tasks.load_task(task(out, log, Schemas={"shop.b": SCHEMA}), spark).run()
    assert rows_of(to.read("shop", "a")) == [(3, "c"), (5, "z")] and rows_of(to.read("shop", "b")) == [(3, "own")]
    assert tasks.load_task(task([{"Type": "DummyOutput"}, {"Type": "LogOutput", "Path": str(tmp_path / "ids")}], log), spark).run() == [None, None]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["0", "1", "2", "4"]
    assert len(tasks.registered()) == 19
    for change in (
        lambda p: p["Input"].update(Type="Nope"), lambda p: p["Output"].update(Type="Nope"), lambda p: p.pop("Processors"), lambda p: p["Processors"].reverse(),
        lambda p: p["Processors"][0].update(Nope=1), lambda p: p["Output"].update(Type="KafkaOutput", Topic="x", Path="y"), lambda p: p["Input"].pop("Path"), lambda p: p["Input"].update(Password="x"),
        lambda p: p.update(Type="Nope"), lambda p: p.update(BufferSize="many"), lambda p: p.update(Output={"Type": "MysqlBatchOutput", "Path": "x", "RoutingBy": "Table"}),
        lambda p: p.update(Output={"Type": "MysqlCheckOutput", "Path": "x", "UpdateTimeColumn": "v", "UpdateTimeSkipSeconds": "x"}), lambda p: p.update(Output={"Type": "MysqlStreamOutput", "Path": "x", "RoutingBy": "Luck"}),
    ):
        bad = task({"Type": "DummyOutput"}, log)
        change(bad["Task"]["Pipeline"])
        with pytest.raises(ChangeError):
            tasks.load_task(bad, spark)
    for more in ({"StateStore": {"Type": "zookeeper", "Addresses": ["x"]}}, {"StateStore": {"Type": "file", "Path": "x", "SaveIntervalMS": 1}}, {"Metrics": {}}, {"PProfPort": 1}):
        with pytest.raises(ChangeError):
            tasks.load_task(task({"Type": "DummyOutput"}, log, **more), spark)


def test_pipelines_in_pipelines(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "ids")
    put_log(spark, log, ("shop.a", "insert", None, ["3", "c"]), ("other.a", "insert", None, ["9", "q"]))
    inner = task(None, log)["Task"]["Pipeline"]
    inner.pop("Output")
    outer = {"Type": "DisruptorPipeline", "Input": inner, "Processors": [], "Output": {"Type": "DisruptorPipeline", "Processors": [{"Type": "JsonMarshaller"}], "Output": {"Type": "LogOutput", "Path": out}}}
    tasks.load_task({"Task": {"ID": "n", "Pipeline": outer}}, spark).run()
    (line,) = spark.read.text(out).collect()
    assert line[0].startswith('0 {"ID":"0"') and '"NewRow":{"k":"3","v":"c"}' in line[0]
    outer["Output"]["Processors"].append({"Type": "MysqlDMLFilter"})
    with pytest.raises(ChangeError):
        tasks.load_task({"Task": {"ID": "n", "Pipeline": outer}}, spark)


def test_streaming_task_replays_and_goes_on(spark, tmp_path):
    log, to, state = str(tmp_path / "log"), Folder(spark, str(tmp_path / "t")), str(tmp_path / "state")
    config = task({"Type": "MysqlStreamOutput", "Path": to.path, "RoutingBy": "PrimaryKey"}, log, Schemas={"shop.a": SCHEMA}, StateStore={"Type": "file", "Path": state, "SyncIntervalMS": 10}, Metrics={"Port": 0}, LogPath=str(tmp_path / "logs"))
    config["Task"]["Pipeline"]["Input"]["Stream"] = True
    config["Task"]["Metrics"]["Port"] = 19148
    put_log(spark, log, ("shop.a", "insert", None, ["1", "a"]))
    first = tasks.load_task(config, spark)
    first.run()
    t = to.snapshot("shop", "a")
    names = t.log()
    assert rows_of(t.read()) == [(1, "a")] and names[-1][2].endswith("-0")
    put_log(spark, log, ("shop.a", "update", ["1", "a"], ["1", "b"]), ("shop.a", "insert", None, ["2", "c"]))
    with pytest.raises(OSError):  # the port is in use
        tasks.load_task(config, spark)
    config["Task"].pop("Metrics")
    p = tasks.load_task(config, spark)
    p.run()
    assert rows_of(t.read()) == [(1, "b"), (2, "c")]
    again = p.transformed(changelog.read_changelog(spark, log))
    p.sinks[0](again, t.log()[-1][2])  # the last batch, once more
    assert len(t.log()) == len(names) + 1 and rows_of(t.read()) == [(1, "b"), (2, "c")]
    import urllib.request

    with urllib.request.urlopen("http://127.0.0.1:19148/metrics") as r:
        assert 'task_events_total{task="t"} 1' in r.read().decode()


def test_scans_are_found_and_resumed(spark, tmp_path):
    src, to = str(tmp_path / "src"), Folder(spark, str(tmp_path / "t"))
    one = spark.range(100).selectExpr("id AS k", "concat('v', id) AS v")
    for name in ("shop/a1", "shop/a2", "shop/zz", "mysql/a1"):
        one.write.parquet(f"{src}/{name}")
    config = {"Task": {"ID": "s", "StateStore": {"Type": "file", "Path": str(tmp_path / "state")}, "Pipeline": {"Input": {"Type": "MysqlScanInput", "Path": src, "TableNameRegex": r"a\d$", "BatchSize": 30, "Keys": ["k"]}, "Processors": [{"Type": "MysqlDMLToDBChangeConverter"}], "Output": {"Type": "MysqlStreamOutput", "Path": to.path}}}}
    p = tasks.load_task(config, spark)
    whole, seen = p.write, []

    def fails(df, token=None):
        if len(seen) == 3:
            raise RuntimeError("lost")
        seen.append(df.count())
        return whole(df, token)

    p.write = fails
    with pytest.raises(RuntimeError):
        p.run()
    p = tasks.load_task(config, spark)
    whole2, more = p.write, []
    p.write = lambda df, token=None: (more.append(df.count()), whole2(df, token))[1]
    p.run()
    assert sum(seen) + sum(more) == 200 and len(seen) == 3 and tasks.load_task(config, spark).run() == []
    assert to.tables() == [("shop", "a1"), ("shop", "a2")] and rows_of(to.read("shop", "a2")) == rows_of(one)
    assert sum(d.count() for d in scan.key_ranges(one, ["k", "v"], 7)) == 100


def test_database_targets(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    j = JdbcTarget(spark, url, batch=2, connections=2)
    j.execute('CREATE TABLE "a" ("k" INT PRIMARY KEY, "v" VARCHAR(9))', 'INSERT INTO "a" VALUES (1, \'a\'), (2, \'b\')')
    log = str(tmp_path / "log")
    put_log(spark, log, ("APP.a", "insert", None, ["3", "c"]), ("APP.a", "update", ["1", "a"], ["5", "z"]), ("APP.a", "delete", ["2", "b"], None))
    config = task({"Type": "MysqlBatchOutput", "Url": url, "SqlBatchSize": 2, "MaxConnections": 2}, log)
    config["Task"]["Pipeline"]["Processors"][0]["FullTableNamePattern"] = "APP"
    for _ in range(2):  # repeated, it changes nothing more
        tasks.load_task(config, spark).run()
        assert rows_of(j.read("APP", "a")) == [(3, "c"), (5, "z")]
    net = spark.createDataFrame([(3, "insert", "no"), (4, "update", "no"), (5, "update", "y"), (6, "insert", "n"), (7, "noop", None)], "k int, op string, v string")
    j.apply(net, "APP", "a", ["k"], "ignore")
    assert rows_of(j.read("APP", "a")) == [(3, "c"), (5, "y"), (6, "n")]
    with pytest.raises(ChangeError):
        j.primary_key("APP", "none")
    check = task({"Type": "MysqlCheckOutput", "Url": url}, log)
    check["Task"]["Pipeline"]["Processors"][0]["FullTableNamePattern"] = "APP"
    assert [r[0] for r in tasks.load_task(check, spark).run()[0].collect()] == ["err:row_diff db:APP table:a  - expected:k:5 v:z real:k:5 v:y"]


def test_raw_logs(spark, tmp_path):
    raw = [
        (1, "gtid", 10, "rot", None, None), (2, "query", 20, None, None, "BEGIN"), (3, "WRITE_ROWS_EVENTv2", 30, "t", [["1", "a"], ["2", "b"]], None), (4, "UPDATE_ROWS_EVENTv2", 40, "t", [["1", "a"], ["1", "x"]], None), (5, "xid", 50, None, None, None),
        (6, "gtid", 60, None, None, None), (7, "DELETE_ROWS_EVENTv2", 70, "t", [["2", "b"]], None), (8, "gtid", 80, None, None, None), (9, "query", 90, None, None, "ALTER TABLE t ADD c INT"),
    ]
    log = spark.createDataFrame([(s, k, 1, "u", s if k == "gtid" else None, "log.1", p, 100 + s, "shop", t, r, q) for s, k, p, t, r, q in raw], binlog.RAW)
    d = {r.id: r for r in binlog.decode(log, "gtid").collect()}
    assert sorted(d) == ["u.1.0", "u.1.1", "u.1.2", "u.6.0"]
    assert d["u.1.0"].pos is None and d["u.6.0"].pos.pos == 50 and (d["u.1.2"].op, d["u.1.2"].old_values) == ("update", ["1", "a"])
    assert sorted(r.id for r in binlog.decode(log, "filepos").collect()) == ["1.log.1.30.0", "1.log.1.30.1", "1.log.1.40.0", "1.log.1.70.0"]
    assert sorted(r.pos for r in binlog.commits(log).where("commit").collect()) == [50, 80, 90]  # an XID, a next GTID, a statement
    info = binlog.server_info(log)
    assert info == {"server_id": 1, "server_uuid": "u", "file": "log.1", "pos": 90, "gtid": True}
    assert binlog.choose_mode(None, info) == "gtid" and binlog.choose_mode("filepos", info) == "filepos"
    with pytest.raises(ChangeError):
        binlog.choose_mode("gtid", info | {"gtid": False})
    done = spark.createDataFrame([("u", 1, 5)], "uuid string, lo long, hi long")
    assert binlog.from_position(log, executed=done).agg(F.min("seq")).first()[0] == 6 and binlog.from_position(log, "log.1", 60).count() == 4
    log.write.parquet(str(tmp_path / "raw"))
    assert binlog.reachable(spark, [str(tmp_path / "none"), str(tmp_path / "raw")]) == str(tmp_path / "raw")
    with pytest.raises(ChangeError):
        binlog.reachable(spark, [str(tmp_path / "none"), None])
    config = task({"Type": "MysqlBatchOutput", "Path": str(tmp_path / "t")}, None, Schemas={"shop.t": SCHEMA})
    config["Task"]["Pipeline"]["Input"] = {"Type": "MysqlBinlogInput", "Address": str(tmp_path / "none"), "BackupAddress": str(tmp_path / "raw"), "ReplicationMode": "gtid"}
    tasks.load_task(config, spark).run()
    assert rows_of(Folder(spark, str(tmp_path / "t")).read("shop", "t")) == [(1, "x")]
    same = spark.range(1).select(binlog.same_hosts(F.array(F.lit("b"), F.lit("a"), F.lit("a")), F.array(F.lit("a"), F.lit("b")))).first()[0]
    assert same is True


def test_statements_that_change_schemas():
    for q, want in {
        "CREATE DATABASE IF NOT EXISTS `s`": [("s", None)], "drop schema s": [("s", None)], "create table if not exists t (a int)": [("d", "t")], "ALTER TABLE `x`.`t` ADD c INT": [("x", "t")],
        "ALTER TABLE t RENAME TO u": [("d", "t"), ("d", "u")], "DROP TABLE a, x.b": [("d", "a"), ("x", "b")], "truncate t": [("d", "t")], "RENAME TABLE a TO b, x.c TO x.d": [("d", "a"), ("d", "b"), ("x", "c"), ("x", "d")],
        "INSERT INTO t VALUES (1)": [], "BEGIN": [], "create user u": [], "/* x */ truncate table x.t": [("x", "t")],
    }.items():
        assert binlog.ddl_targets(q, "d") == want, q
    s = SchemaStore({r"shop\.t\d": SCHEMA}, lambda d, t: table_schema(SCHEMA[:1]) if d == "found" else None)
    assert s.get("shop", "t1").names == ["k", "v"] and s.get("found", "x").names == ["k"]
    s.put("shop", "t1", table_schema(SCHEMA[:1]))
    assert s.get("shop", "t1").names == ["k"]
    s.evict("shop", "t1")
    assert s.get("shop", "t1").names == ["k", "v"]
    s.evict("found")
    assert "found.x" not in s.kept
    with pytest.raises(ChangeError):
        s.get("no", "t")


def test_values_carried_over_ranges(spark):
    rows = [("a", 1, "x"), ("a", 4, None), ("a", 9, None), ("a", 11, "y"), ("a", 30, None), ("b", 2, None), ("b", 8, "z"), (None, 3, "n"), (None, 25, None)]
    d = spark.createDataFrame(rows, "s string, seq long, v string")
    for span in (1, 5, 100):
        got = {(r.s, r.seq): (r.up, r.was) for r in P.carried(P.carried(d, ["s"], "seq", {"up": F.col("v")}, span=span), ["s"], "seq", {"was": F.col("v")}, True, span).collect()}
        assert got == {("a", 1): ("x", None), ("a", 4): ("x", "x"), ("a", 9): ("x", "x"), ("a", 11): ("y", "x"), ("a", 30): ("y", "y"), ("b", 2): (None, None), ("b", 8): ("z", None), (None, 3): ("n", None), (None, 25): ("n", "n")}
        t = spark.createDataFrame([("u", x) for x in (1, 2, 3, 5, 6, 10, 11, 12, 99)], "uuid string, txid long")
        assert rows_of(P.intervals(t, span=span)) == [("u", 1, 3, 3), ("u", 5, 6, 2), ("u", 10, 12, 3), ("u", 99, 99, 1)]


def test_gauges(monkeypatch):
    now = [1000.0]
    g = Gauges("x", clock=lambda: now[0])
    g.read(5, 900)
    assert (g.delay, g.in_flight, g.stuck()) == (100, 5, False)
    now[0] += 5000
    assert g.stuck() and 'task_stuck{task="x"} 1' in g.text()
    g.progress({"processedRowsPerSecond": 12.7, "numInputRows": 5, "batchId": 3})
    assert (g.qps, g.in_flight, g.stuck(), g.rows) == (12, 0, False, 5)


def test_stream_restarts_from_its_checkpoint(spark, sf, tmp_path):
    c = catalogue.changes(spark, sf).cache()
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.write(catalogue._seed(spark, sf), 0)
    log = str(tmp_path / "log")
    for lo, hi in ((0, 15_000_000), (15_000_000, 99_000_000)):  # stopped in between
        c.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(log)
        s = changelog.stream_changelog(spark, log, c.schema)
        s.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(jobs.apply_batches(t, ["o_orderkey"])).start().awaitTermination()
    want = A.apply_changes(catalogue._seed(spark, sf), c, ["o_orderkey"])
    assert t.versions() == [0, 1, 2] and sorted(map(tuple, t.read().collect())) == sorted(map(tuple, want.collect()))


def test_stateful_stream(spark, tmp_path):
    rows = [(1, 1, "insert", "a"), (2, 1, "update", "b"), (3, 2, "insert", "c"), (4, 2, "delete", None), (5, 3, "update", "x")]
    spark.createDataFrame(rows, "seq long, k long, op string, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("seq long, k long, op string, v string").parquet(str(tmp_path / "in"))
    got = []
    q = jobs.stateful_rows(s, "k", "v").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(b.collect())).start()
    q.awaitTermination()
    assert {r.k: (r.v, r.live) for r in got} == {1: ("b", True), 2: (None, False), 3: (None, False)}


def test_order_without_loss(spark):
    d = spark.range(1_000_000).select(F.col("id").alias("seq"), F.lit("t").alias("k"), F.lit("update").alias("op"), F.col("id").alias("v")).withColumn("op", F.when(F.col("seq") == 0, "insert").otherwise("update"))
    r = N.net_changes(d.repartition(8), ["k"], images=["v"]).first()
    assert (r.originals, r.v, r.op) == (1_000_000, 999_999, "insert")


def test_snapshots_are_compacted(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "k int, v string, n int"))
    put = jobs.apply_batches(t, ["k"], stream="x", compact=3)
    for i, e in enumerate([(1, 1, "update", "c", 7), (2, 2, "delete", None, None), (3, 3, "insert", "d", None), (4, 3, "update", "e", 1)]):
        for _ in range(2):  # each batch twice
            put(spark.createDataFrame([e], "seq long, k int, op string, v string, n int"), i)
    assert rows_of(t.read()) == [(1, "c", 7), (3, "e", 1)]
    assert [f[0] for _, f, _ in t.log()][-2:] == ["v", "d"] and rows_of(t.base()) == [(1, "c", 7), (3, "d", None)]


def test_check_output_passes_over_recent_changes(spark, tmp_path):
    import time

    now, to = int(time.time()), Folder(spark, str(tmp_path))
    to.snapshot("s", "t").write(spark.createDataFrame([(1, "x", 0), (2, "x", 0)], "id long, v string, at long"))
    rows = [(i, "insert", "s", "t", None, {"id": str(i), "v": "y", "at": str(at)}) for i, at in ((1, now - 5000), (2, now), (3, now))]
    df = spark.createDataFrame(rows, "seq long, op string, database string, table string, old_row map<string,string>, new_row map<string,string>")
    ctx = tasks.Context(spark, SchemaStore())
    found = lambda **c: sorted(r[0].split()[0] + r[0].split("id:")[1][0] for r in tasks._check_output({"Path": str(tmp_path), "Keys": ["id"], **c}, ctx)(df).collect())
    assert found() == ["err:row_diff1", "err:row_diff2", "err:row_miss3"]
    assert found(UpdateTimeColumn="at", UpdateTimeType="sec", UpdateTimeSkipSeconds=1000) == ["err:row_diff1", "err:row_miss3"]
    for bad in ({"UpdateTimeType": "week"}, {"UpdateTimeSkipSeconds": "x"}):
        with pytest.raises(ChangeError):
            tasks._check_output({"Path": "x", "Keys": ["id"], **bad}, ctx)
    with pytest.raises(ChangeError):
        found(UpdateTimeColumn="none")


def test_times_of_every_kind(spark):
    from changeloom.functions.scalars import older_than

    d = spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS t, 1704067210L AS sec, 1704067210000L AS milli, 1704067210000000000L AS nano")
    for kind, column in (("time", "t"), ("sec", "sec"), ("milli", "milli"), ("nano", "nano")):
        got = [d.select(older_than(F.col(column), now, 5, kind)).first()[0] for now in ("2024-01-01 00:00:15", "2024-01-01 00:00:16")]
        assert got == [False, True], kind


def test_nulls_take_the_default(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    net = spark.createDataFrame([(1, "update", None), (3, "insert", None)], "k int, op string, v string")
    assert rows_of(A.apply_net(t, net, ["k"], null_as_default={"v": "d"})) == [(1, "d"), (2, "b"), (3, None)]


def test_log_files_follow_the_rows(spark, sf, tmp_path, monkeypatch):
    write = changelog.write_log
    monkeypatch.setattr(changelog, "write_log", lambda c, path: write(c, path, rows=200))
    monkeypatch.setattr(catalogue, "_work", lambda spark: str(tmp_path))
    got = catalogue.stream_apply(spark, sf)
    log = spark.read.parquet(str(tmp_path / "log"))
    files = [r.seqs for r in log.groupBy(F.input_file_name()).agg(F.sort_array(F.collect_list("seq")).alias("seqs")).collect()]
    assert len(files) > 5 and max(map(len, files)) < 3 * 200  # three files before, of any length
    ordered = sorted(files)
    assert all(a[-1] < b[0] for a, b in zip(ordered, ordered[1:])) and sum(map(len, files)) == catalogue.changes(spark, sf).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalogue.apply_net(spark, sf).collect()))


def test_a_log_of_very_many_files_is_not_compacted_on_the_way(spark, sf, tmp_path, monkeypatch):
    write = changelog.write_log
    monkeypatch.setattr(changelog, "write_log", lambda c, path: write(c, path, rows=2))
    monkeypatch.setattr(catalogue, "_work", lambda spark: str(tmp_path))
    got = catalogue.stream_apply(spark, sf)
    assert sum(f[0] == "v" for _, f, _ in SnapshotTable(spark, str(tmp_path / "target")).log()) == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalogue.apply_net(spark, sf).collect()))


def test_deleted_keys_are_dealt_by_the_rows_of_the_target(spark):
    rows = [(i // 2 if i % 50 else None, i % 3, f"v{i}") for i in range(4000)]
    target = spark.createDataFrame(rows, "a int, b int, v string")
    gone = spark.createDataFrame([(i % 1000, i % 3) for i in range(3000)] + [(None, 0), (7, None)], "a int, b int")
    left = A.delete_keys(target, gone, ["a", "b"], rows=100).withColumn("task", F.spark_partition_id())
    per_task = [r["count"] for r in left.groupBy("task").count().collect()]
    assert len(per_task) > 20 and max(per_task) < 3 * 100  # of the session's four tasks before
    keys = {(i % 1000, i % 3) for i in range(3000)}
    assert left.columns[:3] == target.columns
    assert sorted(map(repr, ((r.a, r.b, r.v) for r in left.collect()))) == sorted(map(repr, (r for r in rows if r[:2] not in keys)))


def test_one_servers_intervals_are_merged_by_several_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny tables would come to one task
    try:
        d = spark.range(4000).select(F.lit("u").alias("uuid"), (F.col("id") * 2).alias("txid"))
        runs = P.intervals(d, span=100).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in runs.groupBy("task").count().collect()]
        assert sum(per_task) == 4000 and max(per_task) < 3000  # one task held them all before
        assert P.set_text(P.intervals(d, span=100), span=100).first().gtid_set == "u:" + ":".join(str(2 * i) for i in range(4000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_intervals_merge_over_ranges_as_in_one(spark):
    rng, rows = random.Random(7), []
    for u, n in (("a", 1), ("b", 30), ("c", 150), (None, 60)):
        for lo in (rng.randrange(-50, 500) for _ in range(n)):
            rows.append((u, lo, lo + rng.choice([0, 0, 0, 1, 2, 5, rng.randrange(150)])))
    rows += [("d", 0, 0), ("d", 1, 95), ("d", 3, 4), ("d", 50, 60), ("d", 96, 96), ("d", 98, 98), ("d", 98, 98), ("e", 9, 9), ("e", 10, 10), ("e", 40, 40)]
    want: list = []
    for u, lo, hi in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if want and want[-1][0] == u and lo <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], hi)
        else:
            want.append([u, lo, hi])
    merged = P.merge_intervals(spark.createDataFrame(rows, "uuid string, lo long, hi long"), span=10)
    assert sorted(map(repr, (tuple(r) for r in merged.collect()))) == sorted(map(repr, map(tuple, want)))
    texts = {r.uuid: r.gtid_set for r in P.set_text(merged.where("uuid is not null"), span=10).collect()}
    assert texts["d"] == "d:0-96:98" and texts["e"] == "e:9-10:40"

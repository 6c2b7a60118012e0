"""Tasks described as JSON: components by type name, checked when they are built, run in batch or as a stream.

Between stages, ``dml`` frames have id, seq, full_table_name, op, old_values, new_values (and columns, where the source
knows them), db_time and event_time; ``db_change`` frames have id, seq, database, table, db_time, event_time, op and the
maps old_row, new_row and extra_info. Variables are further columns. Outputs that write tables route every change to
the table of its own database and name. Keys that a component does not act on are refused, or, where they only size
the buffers of another runtime, logged.
"""

from __future__ import annotations

import hashlib
import json
import logging
import logging.handlers
import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DML, ChangeError, SchemaStore, effective_row, primary_key
from ..operators import mapping, rows
from ..operators.apply import apply_images, apply_sequential
from ..operators.check import check_rows, recheck, report_lines
from ..operators.merge import net_changes, net_changes_partial, split_key_changes
from ..sinks.jdbc import JdbcTarget, staged
from ..sinks.tables import Folder, queue_of, route_key, within_size
from ..sources import binlog, changelog, scan
from ..streaming.metrics import Gauges, serve, watched

log = logging.getLogger("changeloom")

#: Message types, as stages take and give them.
DML_T, CHANGE, JSON, BYTES, ANY = "dml", "db_change", "json_bytes", "bytes", "any"
#: Sizes of in-memory queues, which Spark does not have.
BUFFERS = ("BufferSize", "TaskQueueLength", "TableBufferSize", "FlushBatch")


@dataclass
class Context:
    """What the components of a task share."""

    spark: SparkSession
    schemas: SchemaStore
    task: str = "task"
    state: str | None = None
    gauges: Gauges | None = None
    trigger_ms: int | None = None
    finished: dict = field(default_factory=dict)

    def saved(self) -> dict:
        """The state that an earlier run saved: finished parts of scans."""
        if self.state and os.path.exists(f"{self.state}/scan.json"):
            with open(f"{self.state}/scan.json") as f:
                return json.load(f)
        return {}

    def save(self, state: dict) -> None:
        """Replaces the state as a whole: a reader sees the old or the new one."""
        if self.state:
            os.makedirs(self.state, exist_ok=True)
            with open(f"{self.state}/scan.json.new", "w") as f:
                json.dump(state, f)
            os.replace(f"{self.state}/scan.json.new", f"{self.state}/scan.json")


@dataclass(frozen=True)
class Component:
    role: str  # input, processor, output or pipeline
    keys: frozenset[str]
    takes: str
    gives: str
    build: Callable
    required: frozenset[str] = frozenset()


@dataclass
class Source:
    """An input: a frame (or stream), or parts by name that are run one by one and not again once they are done."""

    read: Callable[[], DataFrame] | None = None
    parts: Callable[[], Iterator[tuple[str, DataFrame]]] | None = None


_REGISTRY: dict[str, Component] = {}


def register(name: str, role: str, build: Callable, keys: tuple[str, ...] = (), takes: str = ANY, gives: str = ANY, required: tuple[str, ...] = ()) -> None:
    """Adds a component type. ``build(config, context)`` gives an input's Source (or a function that reads a frame), a
    processor's function of a frame, or an output's function of a frame and the batch's token (None in batch)."""
    _REGISTRY[name] = Component(role, frozenset(keys) | frozenset(required), takes, gives, build, frozenset(required))


def registered() -> dict[str, str]:
    return {n: c.role for n, c in _REGISTRY.items()}


@dataclass
class Pipeline:
    source: Source | None
    steps: list[Callable[[DataFrame], DataFrame]]
    sinks: list[Callable[[DataFrame, str | None], object]]
    context: Context
    takes: str = ANY
    gives: str = ANY

    def transformed(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = df.transform(s)
        return df

    def frame(self) -> DataFrame:
        """The input after all processors, as one frame."""
        if self.source is None:
            raise ChangeError("the pipeline has no Input")
        if self.source.read is not None:
            return self.transformed(self.source.read())
        out = None
        for _, df in self.source.parts():
            out = df if out is None else out.unionByName(df, True)
        if out is None:
            raise ChangeError("no table to read")
        return self.transformed(out)

    def write(self, df: DataFrame, token: str | None = None) -> list:
        """All outputs over one frame, which is read once."""
        if len(self.sinks) < 2:
            return [s(df, token) for s in self.sinks]
        df = df.persist()
        try:
            return [s(df, token) for s in self.sinks]
        finally:
            df.unpersist()

    def run(self) -> list:
        """In batch once; parts one by one, passing over those that the state has; a stream until its input is used up,
        or, with a SyncIntervalMS and Continuous, on and on."""
        c = self.context
        if self.source is not None and self.source.parts is not None:
            out, state = [], c.saved()
            for name, df in self.source.parts():
                if name not in state:
                    out += self.write(self.transformed(df))
                    state[name] = "done"
                    c.save(state)
            return out
        df = self.frame()
        if not df.isStreaming:
            return self.write(df)
        if not c.state:
            raise ChangeError("a stream needs a StateStore with a Path")
        gauges = c.gauges or Gauges(c.task)
        name = hashlib.sha256(c.state.encode()).hexdigest()[:12]

        def batch(b: DataFrame, i: int) -> None:
            b = b.persist()
            try:
                has = "db_time" in b.columns
                n, latest = b.agg(F.count("*"), F.max("db_time") if has else F.lit(None)).first()
                gauges.read(n, latest)
                for s in self.sinks:
                    s(b, f"{name}-{i}")
                gauges.in_flight = 0
            finally:
                b.unpersist()

        w = df.writeStream.option("checkpointLocation", f"{c.state}/stream").foreachBatch(batch)
        w = w.trigger(processingTime=f"{c.trigger_ms} milliseconds") if c.trigger_ms else w.trigger(availableNow=True)
        c.spark.streams.addListener(gauges)
        try:
            q = w.start()
            watched(q, gauges, c.spark)
        finally:
            c.spark.streams.removeListener(gauges)
        return [q]


def _component(config: dict, role: str, at: str, ctx: Context):
    if "Type" not in config:
        raise ChangeError(f"{at}: no Type")
    c = _REGISTRY.get(config["Type"])
    if c is not None and c.role == "pipeline" and role in ("input", "output"):  # a pipeline inside a pipeline
        p = build_pipeline(config, ctx, part=role)
        if role == "input":
            return Component("input", frozenset(), ANY, p.gives, c.build), Source(p.frame)
        return Component("output", frozenset(), p.takes, ANY, c.build), lambda df, token=None: p.write(p.transformed(df), token)
    if c is None or c.role != role:
        raise ChangeError(f"{at}: unknown {role} type {config['Type']}")
    given = set(config) - {"Type", "ID"}
    if unknown := given - c.keys:
        raise ChangeError(f"{at}: unknown keys {sorted(unknown)}")
    if missing := c.required - given:
        raise ChangeError(f"{at}: missing keys {sorted(missing)}")
    _buffers(config, at)
    return c, c.build(config, ctx)


def _buffers(config: dict, at: str) -> None:
    for k in BUFFERS:
        if k in config:
            _count(config, k, 1)
            log.info("%s: %s has no effect, Spark sizes its own buffers", at, k)


def _count(config: dict, key: str, default: int, least: int = 1) -> int:
    """A whole number, also as text."""
    try:
        n = int(str(config.get(key, default)))
    except ValueError:
        raise ChangeError(f"{key}: not a number: {config[key]!r}") from None
    if n < least:
        raise ChangeError(f"{key}: less than {least}")
    return n


def build_pipeline(config: dict, ctx: Context, part: str | None = None) -> Pipeline:
    """Checks types, keys and the message types between stages before anything runs.

    A pipeline that is another's Input (``part``) needs no Output and one that is its Output no Input.
    """
    needed = [k for k in ("Input", "Processors", "Output") if not (part == "input" and k == "Output" or part == "output" and k == "Input")]
    for k in needed:
        if k not in config:
            raise ChangeError(f"Pipeline: no {k}")
    if unknown := set(config) - {"ID", "Type", "Concurrency", "BufferSize", *needed}:
        raise ChangeError(f"Pipeline: unknown keys {sorted(unknown)}")
    if config.get("Type") and (config["Type"] not in _REGISTRY or _REGISTRY[config["Type"]].role != "pipeline"):
        raise ChangeError(f"Pipeline: unknown type {config['Type']}")
    _buffers(config, "Pipeline")
    if "Concurrency" in config:
        log.info("Pipeline: Concurrency is that of Spark's tasks; %d was asked for", _count(config, "Concurrency", 4))
    kind, steps, source, takes = ANY, [], None, ANY
    if "Input" in needed:
        c, source = _component(config["Input"], "input", "Input", ctx)
        source = source if isinstance(source, Source) else Source(source)
        kind = c.gives

    def follow(c: Component, at: str, kind: str) -> str:
        nonlocal takes
        if ANY not in (c.takes, kind) and kind not in c.takes.split("|"):
            raise ChangeError(f"{at}: takes {c.takes}, gets {kind}")
        if source is None and takes == ANY:
            takes = c.takes
        return kind if c.gives == ANY else c.gives

    for i, p in enumerate(config["Processors"]):
        c, step = _component(p, "processor", f"Processors[{i}]", ctx)
        kind = follow(c, f"Processors[{i}]", kind)
        steps.append(step)
    sinks, outs = [], []
    if "Output" in needed:
        outs = config["Output"] if isinstance(config["Output"], list) else [config["Output"]]
    for o in outs:  # several outputs share one input
        c, sink = _component(o, "output", "Output", ctx)
        follow(c, "Output", kind)
        sinks.append(sink)
    return Pipeline(source, steps, sinks, ctx, takes, kind)


def load_task(text: str | dict, spark: SparkSession) -> Pipeline:
    """A task from its JSON text or dict: {'Task': {'ID', 'LogPath'?, 'StateStore'?, 'Metrics'?, 'Schemas'?, 'Pipeline'}}.

    Schemas gives tables' columns by 'db.table' (or a pattern): a list of {'name', 'type', 'key'?}, key 'PRI' for the
    primary key. LogPath is a folder for info and error logs; Metrics serves gauges at its Port (0: 9148).
    """
    task = (json.loads(text) if isinstance(text, str) else text).get("Task")
    if not task or not task.get("ID"):
        raise ChangeError("Task: no ID")
    if unknown := set(task) - {"ID", "LogPath", "StateStore", "Metrics", "Schemas", "Pipeline", "Continuous"}:
        raise ChangeError(f"Task: unknown keys {sorted(unknown)}")
    ctx = Context(spark, SchemaStore(task.get("Schemas")), task["ID"])
    store = task.get("StateStore") or {}
    if store:
        if store.get("Type") != "file":
            raise ChangeError(f"StateStore: type {store.get('Type')} is not supported: give a file store with a Path that all hosts share")
        if unknown := set(store) - {"ID", "Type", "Path", "SyncIntervalMS"}:
            raise ChangeError(f"StateStore: unknown keys {sorted(unknown)}")
        ctx.state = store.get("Path")
        if task.get("Continuous"):
            ctx.trigger_ms = _count(store, "SyncIntervalMS", 10_000)
    if "Pipeline" not in task:
        raise ChangeError("Task: no Pipeline")
    pipeline = build_pipeline(task["Pipeline"], ctx)
    if task.get("LogPath"):
        _log_to(task["LogPath"], task["ID"])
    if "Metrics" in task:
        if "Port" not in task["Metrics"]:
            raise ChangeError("Metrics: no Port")
        ctx.gauges = Gauges(task["ID"])
        serve(ctx.gauges, _count(task["Metrics"], "Port", 0, 0) or 9148)
    return pipeline


def _log_to(folder: str, task: str) -> None:
    """Two rotating files: what happens, and errors."""
    os.makedirs(folder, exist_ok=True)
    log.setLevel(logging.INFO)
    for name, keep in (("info", lambda r: r.levelno <= logging.INFO), ("error", lambda r: r.levelno > logging.INFO)):
        path = os.path.abspath(f"{folder}/{task}.{name}.log")
        if any(getattr(h, "baseFilename", None) == path for h in log.handlers):
            continue
        h = logging.handlers.RotatingFileHandler(path, maxBytes=100 << 20, backupCount=5)
        h.addFilter(keep)
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)


# inputs


def _log_input(c: dict, ctx: Context):
    """Change logs (``model.DML``) or raw logs (``binlog.RAW``) in a folder: Path, or the first of Address and
    BackupAddress that can be reached. Start: {'File', 'Pos'} begins a raw log there; Stream follows the folder."""
    if c.get("ReplicationMode") not in (None, "gtid", "filepos"):
        raise ChangeError("ReplicationMode is gtid or filepos")
    if not (c.get("Path") or c.get("Address")):
        raise ChangeError("Input: missing keys ['Path']")
    spark, start = ctx.spark, c.get("Start") or {}

    def read() -> DataFrame:
        path = c.get("Path") or binlog.reachable(spark, [c.get("Address"), c.get("BackupAddress")])
        if c.get("Stream"):
            return changelog.stream_changelog(spark, path, DML, _count(c, "MaxFiles", 1))
        df = changelog.read_changelog(spark, path)
        if "kind" not in df.columns:
            return df
        mode = binlog.choose_mode(c.get("ReplicationMode"), binlog.server_info(df))
        for q, db in df.where("lower(kind) = 'query' and query rlike '(?i)create|drop|alter|truncate|rename'").select("query", "database").distinct().toLocalIterator():
            for name in binlog.ddl_targets(q, db or ""):
                ctx.schemas.evict(*name)
        return binlog.decode(binlog.from_position(df, start.get("File"), start.get("Pos")), mode)

    return read


def _scan_input(c: dict, ctx: Context):
    """Tables of a folder (Path) or database (Url) whose 'db.table' TableNameRegex finds, as inserts in positional form.

    Tables are read in key ranges of about BatchSize rows, or whole without a BatchSize; finished ranges are kept in the
    task's state and not read again. Concurrency is the number of connections to a database.
    """
    if bool(c.get("Path")) == bool(c.get("Url")):
        raise ChangeError("MysqlScanInput: either a Path or a Url is needed")
    size = _count(c, "BatchSize", 0, 0)
    if c.get("Url"):
        target = JdbcTarget(ctx.spark, c["Url"], c.get("User"), c.get("Password"), connections=_count(c, "Concurrency", 8))
        names = [tuple(t.split(".", 1)) for t in c.get("Tables", [])]
        read, key_of = target.read, target.primary_key
        if not names:
            raise ChangeError("MysqlScanInput: a Url needs Tables")
    else:
        folder = Folder(ctx.spark, c["Path"])
        names, read = None, folder.read
        key_of = lambda d, t: _keys(c, ctx, d, t)

    def parts() -> Iterator[tuple[str, DataFrame]]:
        found = scan.matching(names if names is not None else folder.tables(), c.get("TableNameRegex", ""))
        for d, t in found:
            df, keys = read(d, t), key_of(d, t)
            try:
                ctx.schemas.get(d, t)
            except ChangeError:  # the table's own, with its key
                ctx.schemas.put(d, t, T.StructType([T.StructField(f.name, f.dataType, f.nullable, f.metadata | {"pk": f.name in keys}) for f in df.schema]))
            for i, part in enumerate(scan.key_ranges(df, keys, size) if size else [df]):
                yield f"{d}.{t}:{i}", scan.as_rows(part, d, t, keys)

    return Source(parts=parts)


def _kafka_input(c: dict, ctx: Context):
    """A topic's records; Path reads a folder of records (topic, partition, offset, value) in place of servers."""
    if c.get("Path"):
        def read() -> DataFrame:
            df = ctx.spark.read.json(c["Path"], schema="topic string, partition int, offset long, key string, value string")
            return changelog.with_record_id(df.where(F.col("topic").isin(list(c["Topics"]))))
        return read
    if not c.get("ServerAddresses"):
        raise ChangeError("KafkaInput: missing keys ['ServerAddresses']")
    options = {"kafka.group.id": c["ConsumerGroup"]} if c.get("ConsumerGroup") else {}
    return lambda: changelog.read_kafka(ctx.spark, c["ServerAddresses"], c["Topics"], bool(c.get("FromBeginning")), **options)


# processors


def _converter(c: dict, ctx: Context):
    """Columns: all tables' names, or by 'db.table'; else the schema of each event's table, or what the source says."""

    def run(df: DataFrame) -> DataFrame:
        given = c.get("Columns")
        if isinstance(given, list):
            return rows.rows_to_changes(df, given)
        name = F.col("full_table_name")
        own = ctx.schemas.names_column(name)
        for k, v in (given or {}).items():
            own = F.when(name.rlike(f"^(?:{k})$"), F.array(*map(F.lit, v))).otherwise(own)
        return rows.rows_to_changes(df, F.coalesce("columns", own) if "columns" in df.columns else own)

    return run


def _mapping(c: dict, ctx: Context):
    m = mapping.parse_mappings(c["Mappings"])
    return lambda df: mapping.map_changes(df, m, c.get("DBNameVariable"), c.get("TableNameVariable"))


def _unmarshal(c: dict, ctx: Context):
    """seq is the record's offset: a key's changes are in one partition, in order."""

    def run(df: DataFrame) -> DataFrame:
        out = rows.from_json(df)
        if "seq" not in out.columns and "offset" in out.columns:
            out = out.withColumn("seq", F.col("offset"))
        return out

    return run


# outputs


def _keys(c: dict, ctx: Context, database: str, table: str) -> list[str]:
    """A table's key: Keys of the component (for all tables, or by 'db.table' or pattern), else of its schema."""
    import re

    given = c.get("Keys")
    if isinstance(given, list):
        return given
    for k, v in (given or {}).items():
        if k == f"{database}.{table}" or re.fullmatch(k, f"{database}.{table}"):
            return v
    return primary_key(ctx.schemas.get(database, table))


def _per_table(df: DataFrame, threads: int, each: Callable[[str, str, DataFrame], object]) -> list:
    """Runs ``each`` for the changes of every table in the frame, some at once; names are few and come to the driver."""
    if missing := {"seq", "op", "database", "table", "new_row"} - set(df.columns):
        raise ChangeError(f"changes lack {sorted(missing)}")
    df = df.persist()
    try:
        names = sorted(map(tuple, df.select("database", "table").distinct().collect()))
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(lambda n: each(*n, df.where((F.col("database") == n[0]) & (F.col("table") == n[1]))), names))
    finally:
        df.unpersist()


def _net(df: DataFrame, keys: list[str], partial: bool, on_invalid: str) -> DataFrame:
    """Net changes of one table's map images: the key's columns as texts, op and new_row."""
    if "old_row" not in df.columns:
        df = df.withColumn("old_row", F.lit(None).cast("map<string,string>"))
    df = split_key_changes(df.select("seq", "op", "old_row", "new_row"), keys)
    bad = lambda k: F.raise_error(F.lit(f"a change without the key {k}")).cast("string")
    df = df.select("*", *(F.coalesce(effective_row()[k], bad(k)).alias(k) for k in keys))
    return net_changes_partial(df, keys) if partial else net_changes(df, keys, images=["new_row"], on_invalid=on_invalid)


def _apply(mode: str):
    def build(c: dict, ctx: Context):
        """Targets are Path/database/table (made empty where the task's Schemas know a table that is not there) or the
        tables of a database (Url). A batch of a stream that was written already changes nothing. Images: 'partial'
        if updates name only some columns."""
        if bool(c.get("Path")) == bool(c.get("Url")):
            raise ChangeError(f"Mysql{mode.title()}Output: either a Path or a Url is needed")
        wins, partial = c.get("OnConflict", "log_wins"), c.get("Images", "full") == "partial"
        if wins not in ("log_wins", "ignore") or c.get("Images", "full") not in ("full", "partial"):
            raise ChangeError("OnConflict is log_wins or ignore, Images full or partial")
        if c.get("RoutingBy", "Table") not in ("Table", "PrimaryKey"):
            raise ChangeError("RoutingBy is Table or PrimaryKey")
        by_table = c.get("RoutingBy", "Table") == "Table"
        n = _count(c, "Concurrency", 4) if mode == "stream" else _count(c, "TableConcurrency", 1)
        threads = n if mode == "batch" or by_table else 1
        links = n if mode == "stream" else _count(c, "MaxConnections", 100)
        batch = _count(c, "SqlBatchSize", 1000)

        def to_folder(database: str, table: str, df: DataFrame, token: str | None):
            t, keys = Folder(ctx.spark, c["Path"]).snapshot(database, table), _keys(c, ctx, database, table)
            if not t.versions():
                t.write(ctx.spark.createDataFrame([], ctx.schemas.get(database, table)))  # fails where no schema is known
            if token is not None and any(x == token for _, _, x in t.log()):
                return False
            if mode == "stream" and wins == "ignore":
                target = t.read()
                one = split_key_changes(df.select("seq", "op", "old_row", "new_row"), keys)
                image = effective_row()
                one = one.select("seq", "op", *(image[x].cast(k).alias(x) for x, k in target.dtypes))
                return t.write(apply_sequential(target, one, keys), token=token)
            net = _net(df, keys, partial, "error" if mode == "batch" and token is None else "ignore")
            if mode == "stream" and not by_table:
                net = net.repartition(n, queue_of(n, *keys))
            return t.write(apply_images(t.read(), net, keys, wins), token=token)

        def to_database(database: str, table: str, df: DataFrame):
            j = JdbcTarget(ctx.spark, c["Url"], c.get("User"), c.get("Password"), batch, links)
            keys = _keys(c, ctx, database, table) if c.get("Keys") else j.primary_key(database, table)
            net = _net(df, keys, partial, "ignore")
            j.apply(staged(net, j.read(database, table), keys), database, table, keys, wins)
            return True

        def run(df: DataFrame, token: str | None = None):
            if c.get("Url"):
                return _per_table(df, threads, to_database)
            return _per_table(df, threads, lambda d, t, x: to_folder(d, t, x, token))

        return run

    return build


def _check_output(c: dict, ctx: Context):
    """Differences of the changes' rows (each key's last state) from the tables of Path or Url, as lines of ResultFilePath
    (one folder per table) or, without one, as a frame. UpdateTimeColumn turns on the second look."""
    kind = c.get("UpdateTimeType") or "time"
    if kind not in ("time", "sec", "milli", "nano"):
        raise ChangeError(f"MysqlCheckOutput: unknown UpdateTimeType {kind}")
    if bool(c.get("Path")) == bool(c.get("Url")):
        raise ChangeError("MysqlCheckOutput: either a Path or a Url is needed")
    skip, late = _count(c, "UpdateTimeSkipSeconds", 0, 0), c.get("UpdateTimeColumn") or None

    def read(database: str, table: str) -> tuple[DataFrame, list[str]]:
        if c.get("Path"):
            return Folder(ctx.spark, c["Path"]).read(database, table), _keys(c, ctx, database, table)
        j = JdbcTarget(ctx.spark, c["Url"], c.get("User"), c.get("Password"))
        return j.read(database, table), _keys(c, ctx, database, table) if c.get("Keys") else j.primary_key(database, table)

    def each(database: str, table: str, df: DataFrame) -> DataFrame:
        target, keys = read(database, table)
        kinds = dict(target.dtypes)
        names = sorted(df.where("op <> 'delete'").select(F.explode(F.map_keys("new_row"))).distinct().toPandas().iloc[:, 0])  # columns are few
        if late and late not in names:
            raise ChangeError(f"MysqlCheckOutput: {database}.{table} has no column {late}")
        live = _net(df, keys, False, "ignore").where("op in ('insert', 'update')")
        source = live.select(*(F.try_element_at("new_row", F.lit(n)).cast(kinds.get(n, "string")).alias(n) for n in names))
        found = recheck(check_rows(source, target, keys), source, keys, late, c.get("Now"), skip, kind)
        return report_lines(found, database, table)

    def run(df: DataFrame, token: str | None = None):
        def write(database: str, table: str, part: DataFrame):
            lines = each(database, table, part)
            if not c.get("ResultFilePath"):
                return lines
            return lines.write.mode("append").text(f"{c['ResultFilePath']}/{database}.{table}")

        if c.get("ResultFilePath"):
            return _per_table(df, 1, write)
        names = sorted(map(tuple, df.select("database", "table").distinct().collect()))
        out = None
        for d, t in names:
            x = each(d, t, df.where((F.col("database") == d) & (F.col("table") == t)))
            out = x if out is None else out.unionByName(x)
        return out

    return run


def _kafka_output(c: dict, ctx: Context):
    """Path writes records (topic, partition, offset, key, value) to a folder in place of servers; offset is the change's seq."""
    if not (c.get("Topic") or c.get("TopicVariable")):
        raise ChangeError("KafkaOutput: a Topic or a TopicVariable is needed")
    if not (c.get("Path") or c.get("ServerAddresses")):
        raise ChangeError("KafkaOutput: missing keys ['ServerAddresses']")
    most, block = _count(c, "MaxMessageBytes", 10 << 20), bool(c.get("BlockOnHugeMsg"))

    def run(df: DataFrame, token: str | None = None):
        extra = ["seq"] if "seq" in df.columns else []
        out = within_size(route_key(df, "value", c.get("Topic"), c.get("TopicVariable"), c.get("KeyVariable"), extra), "value", most, block)
        if c.get("Path"):
            at = F.col("seq").alias("offset") if extra else F.monotonically_increasing_id().alias("offset")
            out = out.select("topic", queue_of(_count(c, "Partitions", 4), "key").alias("partition"), at, "key", "value")
            return out.write.mode("overwrite" if token else "append").json(f"{c['Path']}/batch={token}" if token else c["Path"])
        w = out.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", ",".join(c["ServerAddresses"]))
        return w.option("kafka.acks", str(c.get("RequiredAcks", "all"))).option("kafka.max.request.size", most).save()

    return run


def _print(only: bool):
    def build(c: dict, ctx: Context):
        """Every change's id (and JSON, after a marshaller), to the log or as text files of Path; DebugOutput: of one Id."""

        def run(df: DataFrame, token: str | None = None):
            if only:
                df = df.where(F.col("id").cast("string") == str(c.get("Id", 13908)))
            line = F.concat_ws(" ", F.col("id").cast("string"), *([F.col("value").cast("string")] if "value" in df.columns else []))
            lines = df.select(F.coalesce(line, F.lit("")).alias("line"))
            if c.get("Path"):
                return lines.write.mode("append").text(c["Path"])
            for r in lines.toLocalIterator():  # one partition at a time
                log.info("%s", r[0])

        return run

    return build


_DB = ("Url", "User", "Password")
register("MysqlBinlogInput", "input", _log_input, ("Path", "Address", "BackupAddress", "ReplicationMode", "Stream", "MaxFiles", "Start"), gives=DML_T)
register("MysqlScanInput", "input", _scan_input, (*_DB, "Path", "Tables", "TableNameRegex", "BatchSize", "Concurrency", "Keys"), gives=DML_T)
register("KafkaInput", "input", _kafka_input, ("ServerAddresses", "Path", "ConsumerGroup", "FromBeginning"), gives=BYTES, required=("Topics",))
register("DisruptorPipeline", "pipeline", build_pipeline)
register("MysqlDMLFilter", "processor", lambda c, s: lambda df: rows.filter_changes(df, c.get("FullTableNamePattern", ""), c.get("Operations")), ("FullTableNamePattern", "Operations"), takes=DML_T)
register("MysqlDMLToDBChangeConverter", "processor", _converter, ("Columns",), takes=DML_T, gives=CHANGE)
register("DBTableNameCatcher", "processor", lambda c, s: lambda df: rows.catch_names(df, c.get("DBNameVariable"), c.get("TableNameVariable"), c.get("DBNamePattern"), c.get("TableNamePattern")), ("DBNameVariable", "TableNameVariable", "DBNamePattern", "TableNamePattern"), takes=DML_T)
register("ColumnValueProcessor", "processor", lambda c, s: lambda df: rows.column_value(df, c["TableNameVariable"], c["TableColumnMappings"], c["OutputVariable"]), takes=CHANGE, required=("TableNameVariable", "TableColumnMappings", "OutputVariable"))
register("ValueMapper", "processor", lambda c, s: lambda df: rows.map_value(df, c["InputVariable"], c["Mappings"], c["OutputVariable"]), required=("InputVariable", "OutputVariable", "Mappings"))
register("DBChangeMappingProcessor", "processor", _mapping, ("DBNameVariable", "TableNameVariable"), takes=CHANGE, gives=CHANGE, required=("Mappings",))
register("JsonMarshaller", "processor", lambda c, s: lambda df: rows.to_json(df), takes=CHANGE, gives=JSON)
register("DBChangeUnmarshaller", "processor", _unmarshal, takes=f"{BYTES}|{JSON}", gives=CHANGE)
register("LogOutput", "output", _print(False), ("Path",))
register("DummyOutput", "output", lambda c, s: lambda df, token=None: df.write.format("noop").mode("overwrite").save())
register("DebugOutput", "output", _print(True), ("Path", "Id"))
register("MysqlStreamOutput", "output", _apply("stream"), (*_DB, "Path", "Keys", "Concurrency", "RoutingBy", "TaskQueueLength", "OnConflict", "Images"), takes=CHANGE)
register("MysqlBatchOutput", "output", _apply("batch"), (*_DB, "Path", "Keys", "MaxConnections", "TableConcurrency", "SqlBatchSize", "OnConflict", "Images"), takes=CHANGE)
register("MysqlCheckOutput", "output", _check_output, (*_DB, "Path", "Keys", "ResultFilePath", "UpdateTimeColumn", "UpdateTimeType", "UpdateTimeSkipSeconds", "TableBufferSize", "Now"), takes=CHANGE)
register("KafkaOutput", "output", _kafka_output, ("ServerAddresses", "Path", "Partitions", "Topic", "TopicVariable", "KeyVariable", "FlushBatch", "MaxMessageBytes", "BlockOnHugeMsg", "RequiredAcks"), takes=f"{JSON}|{BYTES}")

"""The change envelope: one row per change of a row, with images before and after."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, UPDATE, DELETE = "insert", "update", "delete"
OPS = (INSERT, UPDATE, DELETE)

_MAP = T.MapType(T.StringType(), T.StringType())
POSITION = T.StructType([T.StructField(n, t) for n, t in (
    ("binlog_name", T.StringType()), ("binlog_pos", T.LongType()), ("tx_binlog_pos", T.LongType()), ("timestamp", T.LongType()),
    ("server_id", T.LongType()), ("server_uuid", T.StringType()), ("transaction_id", T.LongType()), ("gtid_set", T.StringType()),
    ("row_offset", T.LongType()), ("transaction_offset", T.LongType()))])
#: Multi-table form. Where one table is known, old_row and new_row are structs instead.
ENVELOPE = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.StringType()), ("seq", T.LongType()), ("database", T.StringType()), ("table", T.StringType()), ("db_time", T.LongType()),
    ("event_time", T.LongType()), ("op", T.StringType()), ("old_row", _MAP), ("new_row", _MAP), ("extra_info", _MAP), ("vars", _MAP))])
#: Positional form, as a row-based log gives it.
DML = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.StringType()), ("seq", T.LongType()), ("full_table_name", T.StringType()), ("op", T.StringType()),
    ("old_values", T.ArrayType(T.StringType())), ("new_values", T.ArrayType(T.StringType())), ("db_time", T.LongType()), ("event_time", T.LongType()))])


class ChangeError(ValueError):
    """A configuration or input that the engine refuses."""


def effective_row(op: Column | str = "op", old: Column | str = "old_row", new: Column | str = "new_row") -> Column:
    """The image that identifies a change's row: the old one of a delete, else the new one."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(op) == DELETE, c(old)).otherwise(c(new))


def full_name(database: str = "database", table: str = "table") -> Column:
    return F.concat_ws(".", database, table)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ChangeError(f"columns missing: {', '.join(missing)}")
    return df


_TYPE = re.compile(r"^(\w+)(?:\(([^)]*)\))?")
_PLAIN = {
    "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(),
    "time": T.StringType(), "year": T.IntegerType(), "json": T.StringType(), "enum": T.StringType(), "set": T.StringType(),
} | {t: T.StringType() for t in ("char", "varchar", "tinytext", "text", "mediumtext", "longtext")} | {
    t: T.BinaryType() for t in ("binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob")}
_INTS = {"tinyint": (T.ByteType(), T.ShortType()), "smallint": (T.ShortType(), T.IntegerType()), "mediumint": (T.IntegerType(), T.IntegerType()),
         "int": (T.IntegerType(), T.LongType()), "integer": (T.IntegerType(), T.LongType()), "bigint": (T.LongType(), T.DecimalType(20, 0))}


def column_type(raw: str) -> tuple[T.DataType, dict]:
    """Spark's type for a column's raw type text such as ``decimal(10,2)`` or ``bigint unsigned``, and its metadata.

    Unsigned integers take the next wider type; the scale of a decimal is kept; unknown types are strings.
    """
    m = _TYPE.match(raw.strip().lower())
    name, args = (m[1], [a.strip() for a in (m[2] or "").split(",") if a.strip()]) if m else ("", [])
    unsigned = "unsigned" in raw.lower()
    length = int(args[0]) if args and args[0].isdigit() else 0
    meta = {"raw_type": raw, "unsigned": unsigned, "length": length}
    if name in _INTS:
        return _INTS[name][unsigned], meta
    if name == "decimal":
        return T.DecimalType(min(38, length or 10), int(args[1]) if len(args) > 1 else 0), meta
    if name == "bit":
        return (T.BooleanType() if length <= 1 else T.BinaryType()), meta
    return _PLAIN.get(name, T.StringType()), meta


def table_schema(columns: list[dict]) -> T.StructType:
    """A schema from rows with name, type and optionally key ('PRI'), nullable and default."""
    fields = []
    for c in columns:
        kind, meta = column_type(c["type"])
        fields.append(T.StructField(c["name"], kind, bool(c.get("nullable", True)), meta | {"pk": c.get("key") == "PRI", "default": c.get("default")}))
    return T.StructType(fields)


def primary_key(schema: T.StructType) -> list[str]:
    pk = [f.name for f in schema.fields if f.metadata.get("pk")]
    if not pk:
        raise ChangeError("the table has no primary key")
    return pk


class SchemaStore:
    """Schemas of tables by 'db.table': given ones (names may be patterns), else what ``find`` says, kept until evicted."""

    def __init__(self, given: dict | None = None, find=None):
        self.given = {k: v if isinstance(v, T.StructType) else table_schema(v) for k, v in (given or {}).items()}
        self.find, self.kept = find, {}

    def get(self, database: str, table: str) -> T.StructType:
        name = f"{database}.{table}"
        if name not in self.kept:
            own = self.given.get(name) or next((s for k, s in self.given.items() if re.fullmatch(k, name)), None)
            own = own if own is not None else self.find(database, table) if self.find else None
            if own is None:
                raise ChangeError(f"no schema for {name}")
            self.kept[name] = own
        return self.kept[name]

    def put(self, database: str, table: str, schema: T.StructType) -> None:
        self.kept[f"{database}.{table}"] = schema

    def evict(self, database: str, table: str | None = None) -> None:
        """Forgets a table's schema, or a database's, after a statement that may have changed it."""
        gone = [n for n in self.kept if (n == f"{database}.{table}" if table else n.startswith(f"{database}."))]
        for n in gone:
            del self.kept[n]

    def names_column(self, full_name: Column) -> Column:
        """Each event's column names; null where no schema is known."""
        out = F.lit(None).cast("array<string>")
        for k, s in reversed([*self.given.items(), *self.kept.items()]):
            hit = full_name.rlike(f"^(?:{k})$") if k in self.given and k not in self.kept else full_name == k
            out = F.when(hit, F.array(*map(F.lit, s.names))).otherwise(out)
        return out

"""Row-level processors: filtering, shape conversion, name capture, variables and JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import capture
from ..model import OPS, ChangeError, effective_row


def _prefix(pattern: str) -> str | None:
    """The literal that every match of an anchored pattern starts with."""
    m = re.match(r"\^((?:[A-Za-z0-9_]|\\\.)+)(?![*?{|])", pattern)
    if not m or "|" in pattern:
        return None
    text = m[1] if m.end() == len(pattern) or pattern[m.end()] not in "*?{" else m[1][:-1]
    return text.replace("\\.", ".") or None


def filter_changes(df: DataFrame, pattern: str = "", ops: list[str] | None = None, name: Column | str = "full_table_name") -> DataFrame:
    """Keeps rows whose 'db.table' has a match of ``pattern`` and whose op is among ``ops``; empty ones let all pass.

    An anchored pattern's literal prefix is added as a condition that reaches the scan.
    """
    c = F.col(name) if isinstance(name, str) else name
    if pattern:
        if p := _prefix(pattern):
            df = df.where(c.startswith(p))
        df = df.where(c.rlike(pattern))
    if ops:
        if bad := set(ops) - set(OPS):
            raise ChangeError(f"unknown operations: {sorted(bad)}")
        df = df.where(F.col("op").isin(list(ops)))
    return df


def split_name(name: str = "full_table_name") -> tuple[Column, Column]:
    """Database and table of a name of exactly two parts; other names fail the job."""
    parts = F.split(F.col(name), r"\.")
    ok = F.size(parts) == 2
    bad = F.raise_error(F.concat(F.lit("not a db.table name: "), F.col(name)))
    return F.when(ok, parts[0]).otherwise(bad), F.when(ok, parts[1]).otherwise(bad)


def rows_to_changes(df: DataFrame, columns: list[str] | Column) -> DataFrame:
    """Positional images as name-to-value maps. Empty or null images stay null; a wrong number of values fails.

    ``columns`` are the names of all tables' columns, or a column with each event's own; one without names fails.
    """
    if isinstance(columns, list) and not columns:
        raise ChangeError("no schema for the table")
    names = F.array(*map(F.lit, columns)) if isinstance(columns, list) else columns

    def image(c: str) -> Column:
        n = F.coalesce(F.size(F.col(c)), F.lit(0))
        return F.when(F.col(c).isNull() | (n == 0), F.lit(None)).when(names.isNull(), F.raise_error(F.concat(F.lit("no schema for "), F.col("full_table_name")))).when(n == F.size(names), F.map_from_arrays(names, F.col(c))).otherwise(
            F.raise_error(F.concat(F.lit("column count mismatch in "), F.col("full_table_name"))))

    db, table = split_name()
    rest = [c for c in df.columns if c not in ("full_table_name", "old_values", "new_values", "columns")]
    return df.select(*rest, db.alias("database"), table.alias("table"), image("old_values").alias("old_row"), image("new_values").alias("new_row"))


def catch_names(df: DataFrame, db_var: str | None = None, table_var: str | None = None, db_pattern: str | None = None, table_pattern: str | None = None, name: str = "full_table_name") -> DataFrame:
    """Adds variables (columns) from the parts of 'db.table'. A null variable is unset."""
    if not db_var and not table_var:
        raise ChangeError("neither a database nor a table variable is set")
    if (db_pattern and not db_var) or (table_pattern and not table_var):
        raise ChangeError("a pattern needs a variable")
    db, table = split_name(name)
    if db_var:
        df = df.withColumn(db_var, capture(db, db_pattern))
    return df.withColumn(table_var, capture(table, table_pattern)) if table_var else df


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def column_value(df: DataFrame, table_var: str, columns: dict[str, str], out: str) -> DataFrame:
    """out := the effective row's value of the column that is mapped to the table variable.

    An unset variable or an unmapped table fails; a missing column gives null.
    """
    column = _lookup(columns, F.col(table_var))
    value = F.try_element_at(effective_row(), column)
    bad = F.raise_error(F.concat(F.lit("no column mapping for table "), F.coalesce(F.col(table_var), F.lit("(unset)"))))
    return df.withColumn(out, F.when(F.col(table_var).isNull() | column.isNull(), bad).otherwise(value))


def map_value(df: DataFrame, source: str, mapping: dict[str, str], out: str) -> DataFrame:
    """out := mapping[source]; unmapped values give '', an unset variable fails."""
    bad = F.raise_error(F.lit(f"variable {source} is not set"))
    return df.withColumn(out, F.when(F.col(source).isNull(), bad).otherwise(F.coalesce(_lookup(mapping, F.col(source)), F.lit(""))))


#: Field names of a change event in JSON, and the envelope's columns.
JSON_FIELDS = [("ID", "id"), ("Database", "database"), ("Table", "table"), ("DBTime", "db_time"), ("EventTime", "event_time"), ("Operation", "op"), ("OldRow", "old_row"), ("NewRow", "new_row"), ("ExtraInfo", "extra_info")]


def to_json(df: DataFrame, out: str = "value") -> DataFrame:
    """Adds the JSON of each change. Nulls are written; images may be maps or structs."""
    known = [F.col(c).alias(n) if c in df.columns else F.lit(None).cast("string").alias(n) for n, c in JSON_FIELDS]
    return df.withColumn(out, F.to_json(F.struct(*known), {"ignoreNullFields": "false"}))


def from_json(df: DataFrame, value: str = "value", row: T.DataType | None = None) -> DataFrame:
    """Changes of a JSON column (string or bytes), typed, so integers stay exact; malformed text fails the job."""
    row = row or T.MapType(T.StringType(), T.StringType())
    kinds = {"db_time": T.LongType(), "event_time": T.LongType(), "old_row": row, "new_row": row, "extra_info": T.MapType(T.StringType(), T.StringType())}
    schema = T.StructType([T.StructField(n, kinds.get(c, T.StringType())) for n, c in JSON_FIELDS])
    x = F.from_json(F.col(value).cast("string"), schema, {"mode": "FAILFAST"})
    rest = [c for c in df.columns if c not in {value} | {c for _, c in JSON_FIELDS}]
    return df.select(*rest, x.alias("_x")).select(*rest, *(F.col(f"_x.{n}").alias(c) for n, c in JSON_FIELDS))

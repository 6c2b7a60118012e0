"""Renaming of databases, tables, columns and operations of change events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_replaced
from ..model import DELETE, INSERT, OPS, UPDATE, ChangeError


@dataclass(frozen=True)
class TableMapping:
    source: str
    target: str
    columns: dict[str, str] = field(default_factory=dict)
    actions: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class DatabaseMapping:
    source: str
    target: str
    tables: tuple[TableMapping, ...] = ()


def _pairs(source: dict, target: dict, key: str, what: str) -> list[tuple]:
    a, b = source.get(key) or [], target.get(key) or []
    if a and len(a) != len(b):
        raise ChangeError(f"as many source as target {what} are needed")
    return list(zip(a, b))


def parse_mappings(config: list[dict]) -> tuple[DatabaseMapping, ...]:
    """Mappings of a task's configuration: Source and Target lists that pair by position. Faults raise."""
    if not config:
        raise ChangeError("no mappings")
    out = []
    for m in config:
        try:
            source, target = m["Source"], m["Target"]
            tables = []
            for a, b in _pairs(source, target, "Tables", "tables"):
                actions = dict(_pairs(a, b, "Actions", "actions"))
                if bad := {*actions, *actions.values()} - set(OPS):
                    raise ChangeError(f"unknown actions: {sorted(bad)}")
                tables.append(TableMapping(a["Table"], b["Table"], dict(_pairs(a, b, "Columns", "columns")), actions))
            out.append(DatabaseMapping(source["DB"], target["DB"], tuple(tables)))
        except KeyError as e:
            raise ChangeError(f"mapping without {e.args[0]}") from None
    return tuple(out)


def convert_action(df: DataFrame, actions: Column) -> DataFrame:
    """Applies the operation that ``actions`` (a column, null for none) gives, moving images as the new one needs."""
    null = F.lit(None)
    was = F.col("op")
    to = F.coalesce(actions, was)
    old = (
        F.when((was == INSERT) & (to != INSERT), F.col("new_row"))
        .when((was == UPDATE) & (to == INSERT), null)
        .when((was == UPDATE) & (to == DELETE), F.col("new_row"))
        .when((was == DELETE) & (to == INSERT), null)
        .otherwise(F.col("old_row"))
    )
    new = F.when((was != DELETE) & (to == DELETE), null).when((was == DELETE) & (to != DELETE), F.col("old_row")).otherwise(F.col("new_row"))
    return df.withColumns({"op": to, "old_row": old, "new_row": new})


def map_changes(df: DataFrame, mappings: tuple[DatabaseMapping, ...], db_var: str | None = None, table_var: str | None = None) -> DataFrame:
    """Renames the parts of multi-table changes (images are maps).

    With a variable, the name's first occurrence of the variable's value is replaced and an unset variable fails;
    without one, whole names are compared. A change whose database has no mapping passes unchanged; one whose table
    has none keeps the renamed database. Columns are renamed all at once, so swaps work; unmapped ones are kept, and
    a rename onto another column's name fails.
    """
    if not mappings:
        raise ChangeError("no mappings")
    if len({m.source for m in mappings}) < len(mappings) or any(len({t.source for t in m.tables}) < len(m.tables) for m in mappings):
        raise ChangeError("a name is mapped twice")

    def key(var: str | None, column: str) -> Column:
        if not var:
            return F.col(column)
        return F.when(F.col(var).isNull(), F.raise_error(F.lit(f"variable {var} is not set")).cast("string")).otherwise(F.col(var))

    db_key, table_key = key(db_var, "database"), key(table_var, "table")
    db, table, action, renames = F.col("database"), F.col("table"), F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for m in mappings:
        in_db = db_key == m.source
        db = F.when(in_db, first_replaced(F.col("database"), m.source, m.target) if db_var else F.lit(m.target)).otherwise(db)
        for t in m.tables:
            here = in_db & (table_key == t.source)
            table = F.when(here, first_replaced(F.col("table"), t.source, t.target) if table_var else F.lit(t.target)).otherwise(table)
            for a, b in t.actions.items():
                action = F.when(here & (F.col("op") == a), F.lit(b)).otherwise(action)
            if t.columns:
                renames = F.when(here, F.create_map(*(F.lit(x) for kv in t.columns.items() for x in kv))).otherwise(renames)
    df = df.withColumns({"_db": db, "_table": table, "_action": action, "_renames": renames})
    df = convert_action(df, F.col("_action"))

    def renamed(c: str) -> Column:
        to = lambda k, _: F.coalesce(F.try_element_at(F.col("_renames"), k), k)
        return F.when(F.col("_renames").isNull() | F.col(c).isNull(), F.col(c)).otherwise(F.transform_keys(c, to))

    df = df.withColumns({"old_row": renamed("old_row"), "new_row": renamed("new_row"), "database": F.col("_db"), "table": F.col("_table")})
    return df.drop("_db", "_table", "_action", "_renames")

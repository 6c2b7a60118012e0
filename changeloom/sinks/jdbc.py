"""Targets in a database: net changes go to a staging table in bounded batches and from there, at once, to the target."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ChangeError


class JdbcTarget:
    """A database reached by Spark's JDBC source; its driver must be on the class path."""

    def __init__(self, spark: SparkSession, url: str, user: str | None = None, password: str | None = None, batch: int = 1000, connections: int = 8):
        self.spark, self.url, self.batch, self.connections = spark, url, batch, connections
        self.properties = {k: v for k, v in (("user", user), ("password", password)) if v is not None}
        self._dialect = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)

    def quoted(self, *names: str) -> str:
        return ".".join(self._dialect.quoteIdentifier(n) for n in names if n)

    def _connection(self):
        p = self.spark.sparkContext._jvm.java.util.Properties()
        for k, v in self.properties.items():
            p.setProperty(k, v)
        return self.spark.sparkContext._jvm.java.sql.DriverManager.getConnection(self.url, p)

    def execute(self, *statements: str) -> None:
        """Runs the statements in one transaction."""
        c = self._connection()
        try:
            c.setAutoCommit(False)
            for s in statements:
                st = c.createStatement()
                st.executeUpdate(s)
                st.close()
            c.commit()
        except Exception:
            c.rollback()
            raise
        finally:
            c.close()

    def primary_key(self, database: str, table: str) -> list[str]:
        """The key's columns in their order, by the database's own account."""
        c = self._connection()
        try:
            rs, out = c.getMetaData().getPrimaryKeys(None, database or None, table), []
            while rs.next():
                out.append((rs.getShort("KEY_SEQ"), rs.getString("COLUMN_NAME")))
        finally:
            c.close()
        if not out:
            raise ChangeError(f"{database}.{table} has no primary key, or is not there")
        return [n for _, n in sorted(out)]

    def _texts(self, database: str, table: str) -> dict[str, int]:
        """The lengths of the table's bounded text columns, which staging takes over: other text types may not compare."""
        c = self._connection()
        try:
            rs, out = c.getMetaData().getColumns(None, database or None, table, None), {}
            while rs.next():
                if "CHAR" in rs.getString("TYPE_NAME").upper():
                    out[rs.getString("COLUMN_NAME")] = rs.getInt("COLUMN_SIZE")
        finally:
            c.close()
        return out

    def read(self, database: str, table: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, self.quoted(database, table), properties=self.properties)

    def apply(self, net: DataFrame, database: str, table: str, keys: list[str], on_conflict: str = "log_wins") -> None:
        """Net changes (keys, op and the columns that are written) as deletes and inserts of whole rows.

        Staging is written by ``connections`` tasks in batches of ``batch`` rows; the two statements that follow are one
        transaction, so a repeated batch gives the same rows. 'ignore' keeps rows that an insert meets, and updates need
        a row. Columns of the target that the changes do not name are not kept by an update: name them all.
        """
        stage = f"stage_{uuid.uuid4().hex[:12]}"
        idle = F.col("op").isin("delete", "noop")  # their values are not used; some databases refuse an untyped null
        n = net.withColumns({c: F.when(idle, F.lit("")).otherwise(F.col(c)) for c, k in net.dtypes if k == "string" and c not in [*keys, "op"]})
        n = n.withColumnRenamed("op", "change_op").coalesce(self.connections)
        sizes = {k: v for k, v in self._texts(database, table).items() if dict(n.dtypes).get(k) == "string"} | {"change_op": 8}
        types = ", ".join(f"`{k}` VARCHAR({v})" for k, v in sizes.items())
        n.write.option("batchsize", self.batch).option("createTableColumnTypes", types).jdbc(self.url, self.quoted(database, stage), "overwrite", self.properties)
        t, s, q = self.quoted(database, table), self.quoted(database, stage), self.quoted
        on = lambda a, b: " AND ".join(f"{a}.{q(k)} = {b}.{q(k)}" for k in keys)
        met = f"EXISTS (SELECT 1 FROM {t} t WHERE {on('t', s)})"
        cols, op = [c for c in net.columns if c != "op"], q("change_op")
        steps = []
        if on_conflict == "ignore":
            steps = [f"DELETE FROM {s} WHERE {op} = 'noop' OR ({op} = 'insert' AND {met}) OR ({op} = 'update' AND NOT {met})"]
        steps.append(f"DELETE FROM {t} WHERE EXISTS (SELECT 1 FROM {s} s WHERE {on('s', t)})")
        steps.append(f"INSERT INTO {t} ({', '.join(map(q, cols))}) SELECT {', '.join(f's.{q(c)}' for c in cols)} FROM {s} s WHERE s.{op} IN ('insert', 'update')")
        try:
            self.execute(*steps)
        finally:
            self.execute(f"DROP TABLE {s}")


def staged(net: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Net changes with a map image as the columns of ``target`` that occur in the image, in its types."""
    kinds = dict(target.dtypes)
    return net.select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), "op", *(F.try_element_at("new_row", F.lit(c)).cast(kinds[c]).alias(c) for c in target.columns if c not in keys))

"""Change logs kept as files: batch and streaming readers, and decoding of raw row events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DELETE, INSERT, UPDATE, ChangeError
from ..operators.position import explode_row_pairs


def read_changelog(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.schema(schema) if schema else spark.read
    return r.parquet(path)


#: Changes of a log file, which one task puts in order.
FILE_ROWS = 1_000_000


def write_log(changes: DataFrame, path: str, seq: str = "seq", rows: int = FILE_ROWS) -> int:
    """Writes changes as files that each hold about ``rows`` consecutive ones, in order; gives the number of files aimed at.

    The changes are counted first: a task sorts one file's rows, however many files the log has.
    """
    n = max(1, -(-changes.count() // rows))
    changes.repartitionByRange(n, seq).sortWithinPartitions(seq).write.parquet(path)
    return n


def stream_changelog(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """A stream over a folder that change-log files are added to; resumes from the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def event_operation(kind: Column) -> Column:
    """write_rows, update_rows and delete_rows events (any version) as operations; others fail."""
    k = F.lower(kind)
    return F.when(k.rlike("^write_rows"), INSERT).when(k.rlike("^update_rows"), UPDATE).when(k.rlike("^delete_rows"), DELETE).otherwise(
        F.raise_error(F.concat(F.lit("not a row event: "), kind)).cast("string"))


def explode_events(events: DataFrame) -> DataFrame:
    """Row events (kind, rows: a list of images, ...) as one row per changed row: op, row_index, old_values, new_values."""
    e = events.withColumn("op", event_operation(F.col("kind")))
    updates = explode_row_pairs(e.where(F.col("op") == UPDATE))
    rest = [c for c in e.columns if c != "rows"]
    one = e.where(F.col("op") != UPDATE).select(*rest, F.posexplode("rows").alias("row_index", "_r"))
    null = F.lit(None).cast(e.schema["rows"].dataType.elementType)
    one = one.select(*rest, "row_index", F.when(F.col("op") == DELETE, F.col("_r")).otherwise(null).alias("old_values"), F.when(F.col("op") == INSERT, F.col("_r")).otherwise(null).alias("new_values"))
    return one.unionByName(updates)


def read_kafka(spark: SparkSession, servers: list[str], topics: list[str], from_beginning: bool = False, stream: bool = True, **options: str) -> DataFrame:
    """Raw records with id topic.partition.offset. Needs Spark's Kafka connector on the class path."""
    if not servers or not topics:
        raise ChangeError("servers and topics are needed")
    r = (spark.readStream if stream else spark.read).format("kafka").options(**options).option("kafka.bootstrap.servers", ",".join(servers)).option("subscribe", ",".join(topics))
    try:
        df = r.option("startingOffsets", "earliest" if from_beginning or not stream else "latest").load()
    except Exception as e:
        if "kafka" in str(e).lower():
            raise ChangeError("the Kafka connector is not on the class path") from e
        raise
    return with_record_id(df)


def with_record_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.concat_ws(".", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")))

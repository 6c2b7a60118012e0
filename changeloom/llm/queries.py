"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embeddup, jaccard, licenses, lm, mixing, pii, quality, warc
from .sql import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


#: The mix's branch weights. Domains group the sources by number; other nodes have a weight of 1.
WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0, ("d0", "en"): 2.0, ("d1", "en"): 2.0}


def with_domain(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as long)"), F.lit(0))
    return docs.withColumn("domain", F.concat(F.lit("d"), (n % 4).cast("string")))


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    out = quality.score(docs, quality.fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(licenses.TEMPLATES, "template_id string, text string")
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), templates)


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.stupid_backoff(table(spark, sf_dir, "documents"))


def op6_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op8_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mixing.mix(docs, WEIGHTS).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    fs = [op1_pii_skip_chain, op2_quality_nbsvm, op3_subspace_pigeonhole, op4_license_minhash, op5_stupid_backoff, op6_count_vector_rtree, op7_quotation_linking, op8_hierarchical_mixing, op9_warc_segments, op10_winnowing, pipeline]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

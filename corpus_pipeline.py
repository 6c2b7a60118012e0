"""The training-data pipeline: quality, near duplicates, decontamination, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import decontam, jaccard, mixing, pii, quality
from changeloom.llm.common import stored
from changeloom.llm.queries import WEIGHTS, held_out, table, with_domain


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores at 0.3 or more. It is fitted to the labelled ones outside the held-out fold, as op2 is."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = quality.fit(docs, labels.select("doc_id", "quality"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window of eight words with the benchmark."""
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)
    return out.where(~F.col("contaminated")).select(*docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind; n_chars follows the text."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows of documents with epoch, domain and n_tokens."""
    return mixing.mix(with_domain(docs), WEIGHTS).drop("rank_hash")


STAGES = [("quality", by_quality), ("near_copies", without_copies), ("decontamination", decontaminated), ("personal_data", masked), ("mixing", mixed)]

#: The classifier, the components and the field's messages have no SQL. A test recomputes the rows of each stage on a small
#: table: near copies pair by pair, windows one by one, masked texts, and budgets and prefixes of the mix; of the classifier,
#: that its labels are outside the held-out fold and that the stage's decisions are those of its scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

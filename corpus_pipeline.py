"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, packing. Each stage works on all that the one before it kept."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.llm import decontaminate, dedup_exact, dedup_near, packing, quality
from marquee.operators.staging import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return dedup_exact.rows_of(docs, dedup_exact.exact_dedup(docs).filter("kept"), once=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; of those without words one of each id and text."""
    found = staged(dedup_near.near_dedup(docs).select("doc_id", "text_key", "root"), "near")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("at")
    chosen = found.filter("root IS NOT NULL").groupBy("root").agg(best).select("at.doc_id", "at.text_key")
    return dedup_exact.rows_of(docs, chosen.unionByName(found.filter("root IS NULL").drop("root")), once=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return dedup_exact.rows_of(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences with their ids, by sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact dedup", without_copies), ("near dedup", without_near_copies),
          ("decontamination", decontaminated), ("packing", packed)]
ORACLE_SQL = None  # a trained classifier and a tokenizer are no SQL; tests/llm compares the result with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``. Null texts count as empty; empty tables pass through; columns beyond
those of ``documents`` are dropped by the first stage.

SQL can't express the classifier, the forest or the packing, so ``ORACLE_SQL`` is None; a test holds run() against a plain version of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, gbt, linededup, neardup, packing
from quillon.llm.bpe import default_vocabulary
from quillon.llm.common import Stage, crc32_mod, has_columns

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below 0.7; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc32_mod("doc_id", gbt.HELD_OUT[0]) != gbt.HELD_OUT[1])
    docs = has_columns(docs, COLUMNS)
    return gbt.score(docs, gbt.train(docs, labels), COLUMNS).where("score >= 0.7").drop("score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated multi-line chunks out of the texts; a document of which nothing is left goes."""
    out = linededup.dedup_lines(spark, has_columns(docs, COLUMNS))
    out = out.where("NOT (_n_removed_chunks > 0 AND text = '')")
    return out.withColumn("n_chars", F.when(F.col("_n_removed_chunks") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, similarity 0.8)."""
    docs = has_columns(docs, COLUMNS)
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1").limit(1).count():
        found = neardup.near_duplicates(spark, docs)
        gone = found.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)
    # rows that repeat an id are one document only if their texts are equal or linked: numbers by (id, text) stand for the ids
    stage = Stage(spark, "near_numbers")
    known = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r")).select("doc_id", "text", "r.*")
    key = F.xxhash64("text")
    ordered = known.repartitionByRange("doc_id", key, "text").sortWithinPartitions("doc_id", key, "text")
    known = stage.table(ordered.withColumn("_number", F.monotonically_increasing_id()), "numbers")
    found = neardup.near_duplicates(spark, known.select(F.col("_number").alias("doc_id"), "text"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_number")).distinct()
    return known.join(gone, "_number", "left_anti").select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    docs = has_columns(docs, COLUMNS)
    found = decontam.contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash"))
    return docs.join(bad, F.expr("doc_id <=> _id AND xxhash64(coalesce(text, '')) = _hash"), "left_anti").select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 ids."""
    return packing.pack_documents(spark, docs, default_vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage.table(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

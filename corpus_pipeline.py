"""Training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents; other columns go. Rows are judged one by one, by doc_id and text: rows that share a doc_id don't
share a verdict, repeated rows do. Rows with a null doc_id are judged as others are, but for near_dedup, where they are no one's copies and stay.
Null and empty texts stay in every stage (one token in the last). Very long texts are read whole. Ties at a threshold stay. Without labels or
benchmark items nothing is rejected for them; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import decontamination, minhash_dedup, packing, quality, substring_dedup
from fieldspark.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _print() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but the rows of gone (doc_id, print)."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print")).distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")) & (_print() == F.col("gone_print")), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return _without(docs, quality.classify(docs, trusted, by_text=True).where("rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of those that repeat its doc_id and text."""
    out = _without(docs, minhash_dedup.near_duplicates(docs, by_text=True).where("not kept"))
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return out
    return out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages seen earlier; a document of which nothing is left goes."""
    out = substring_dedup.deduplicate(docs, carry=("text", "lang", "source", "n_chars"))
    out = out.where("not (n_removed > 0 and kept_text = '')")
    cut = F.col("n_removed") > 0
    # untouched documents keep their own white space
    return out.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark leaks."""
    rows = docs.select(F.struct("doc_id", _print().alias("print")).alias("doc_id"), "text")
    return _without(docs, decontamination.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, one row for each piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

ORACLE_SQL = None  # perplexities and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), spark, name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

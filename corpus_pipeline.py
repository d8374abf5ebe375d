"""A document pipeline: quality, rules, near-duplicates, repeated passages, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that the next one reads
(the last one returns pieces); ``run`` stores every stage's result as Parquet in the
folder that ``spark.checkpoint.dir`` names. ORACLE_SQL is None: the stages' models have
no SQL; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.llm import line_crf, ngram_join, packing, quality_rules, suffix_dedup
from valuelens.llm.common import stage, table

#: A document goes when its quality is below this.
LEAST_QUALITY = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts; it learns from the labelled rows of folds 1 to 4 of 5.

    A null text scores as the empty one.
    """
    scored = line_crf.score(docs.select(*COLUMNS), line_crf.fitted(spark, sf_dir), list(COLUMNS))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def weak_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model of the quality rules keeps."""
    return quality_rules.judge(docs.select(*COLUMNS), list(COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, the one with the least doc_id; of rows that repeat it one stays.

    Documents without doc_id come last in a class; one of a class of these stays. Rows of
    one doc_id with different texts are different documents.
    """
    named = docs.select(*COLUMNS).withColumn("name", F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("text")))
    kept = ngram_join.join_similar(named, "name").where("name = class_id").select("name").distinct()
    return named.join(kept, "name").dropDuplicates(["name"]).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the bytes of 200-byte strings that occur twice; n_chars follows the text."""
    rest = [c for c in COLUMNS if c not in ("text", "n_chars")]
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), rest, kept_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", weak_rules), ("n-gram Jaccard join", near_duplicates),
          ("suffix-array dedup", repeated_strings), ("packing", packed_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

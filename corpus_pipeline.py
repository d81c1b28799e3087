"""The corpus pipeline: quality, recurring lines, near duplicates, benchmark passages, packing.

STAGES are (name, function) with functions of (spark, docs, sf_dir); each stage's rows are written as Parquet and read
again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import common, decontamination, line_dedup, ngram_join, packing, quality

#: Models and clusters can't be expressed in SQL; tests hold every stage against brute force or planted cases.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores under 0.5.

    Each row is scored by its own text, so rows without a doc_id, or that share one, are documents of their own, and rows
    that repeat go or stay together; null and empty texts are scored as empty. No rows, no rows. Columns stay as they are.
    """
    model = quality.train(docs, common.read(spark, sf_dir, "labels"))
    return quality.score(spark, docs, model).where("score >= 0.5").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts without lines of recurring templates; n_chars follows the text.

    A document of such lines alone goes. Empty and null texts have no lines and stay; so do texts that none of their
    lines leaves. Rows without a doc_id, or that share one, are documents of their own. Other columns stay as they are.
    """
    left = line_dedup.drop_recurring(spark, docs)
    kept = left.where((F.col("_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))  # a document of such lines alone has nothing left
    chars = F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", chars).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the one of the smallest doc_id, of rows that repeat any one.

    Rows without a doc_id, or that share one with another text, are documents of their own; texts without words have no
    near duplicates. Columns stay as they are.
    """
    return ngram_join.one_of_each(spark, docs, words=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    A hit counts for the doc_id (or its absence) together with the text it was found in: another document under the same
    doc_id, or another one without any, stays unless it holds an item itself. Null and empty texts hold none and stay.
    Columns stay as they are.
    """
    texts = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("_row"))
    hits = decontamination.contaminated(spark, texts, common.read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_hit_id"), F.col("_row").alias("_hit_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(hits["_hit_id"]) & (F.xxhash64(docs["text"].cast("string")) == hits["_hit_text"])
    return docs.join(hits, same, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; a row for each piece. Null and empty texts are a piece of one id."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last leaves is a table in the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.table(spark, docs, f"stage-{k}")
    return docs

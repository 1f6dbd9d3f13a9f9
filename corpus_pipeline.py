"""The corpus pipeline: stages that read the documents their predecessor kept.

Every stage takes the columns of documents and returns them, but for the last one, which returns the encoding of
each text under its doc_id and leaves text and metadata behind. Other columns pass through, whatever their names. Rows that repeat in id and text
are one document from exact dedup on. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausegrid.checkpoints import checkpoint
from clausegrid.llm import decontaminate, exact_dedup, language_id, ngram_join, piece_codec


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters (null and empty ones too), or that no learned language is likely for, go."""
    return language_id.keep_known(docs, language_id.learned(docs))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the row with the largest doc_id stays; null texts count as empty, null ids give way."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, of five words and 0.8 or more: of each group of linked documents, the one with the least doc_id stays; documents without words stay."""
    return ngram_join.keep_one(docs, percent=80, words=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: spans of test items are cut; documents made up of them go. Texts without words stay."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: doc_id, the piece numbers of each text (none of a null or empty one), and whether they decode to it."""
    return piece_codec.encode(docs)


STAGES = [
    ("language ID", languages),
    ("exact dedup", copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", pieces),
]

#: A trained model, a similarity join and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder once, so no stage runs twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

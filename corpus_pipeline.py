"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, tokens.

Each stage maps (spark, docs, sf_dir) to a DataFrame; the next stage gets it written and read again.
All but the last return the columns of documents.  A null text counts as empty everywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.llm import count_rtree, line_crf, line_runs, registry, sentencepiece_bpe, suffix_decontam
from pulsegrain.llm.common import delete_folder, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the line labels reject; equal ids are judged by their own text."""
    chain = line_crf.train(docs, table(spark, sf_dir, "labels"))
    keep = line_crf.keep(docs, chain)
    return keep.select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves repeated long lines in one document; a document left without any word goes."""
    left = line_runs.dedup_lines(docs).drop("_n_lines", "_n_dropped")
    return left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies: five words, similarity 0.8 or more."""
    return count_rtree.keep_one(docs, words=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return suffix_decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return sentencepiece_bpe.encode(docs, sentencepiece_bpe.model_file(f"{registry.TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard), ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}"
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs


#: The line labels, merge rounds and classes of near copies are beyond plain SQL.
ORACLE_SQL = None

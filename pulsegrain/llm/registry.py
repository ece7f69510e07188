"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, companions, count_rtree, disclosure_pii, html_extraction, line_crf, line_runs, mil_toxicity, sentencepiece_bpe, suffix_decontam, url_templates
from .common import table

#: Folder of the public tokenizer files; a parameter, never copied here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil_toxicity.train(docs, table(spark, sf_dir, "labels").where(~mil_toxicity.held_out()))
    scored = mil_toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(mil_toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "n_offending", "worst_sentence")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rtree.classify(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure_pii.digest(disclosure_pii.find(table(spark, sf_dir, "documents")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_bpe.model_file(f"{TOKENIZERS}/piece_bpe_32k.model")
    return sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), model)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontam.digest(suffix_decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extraction.main_text(pages, html_extraction.train(pages))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(line_runs.dedup_lines(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_pii": op4_pii,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    **companions.QUERIES,
}
ORACLE_SQL: dict[str, str] = {"op3_ngram_jaccard": count_rtree.ORACLE_SQL, "op6_decontamination": suffix_decontam.ORACLE_SQL, "op10_line_dedup": line_runs.ORACLE_SQL, **companions.ORACLE_SQL}

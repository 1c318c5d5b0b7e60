"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, licences, lmscore, njaccard, quality, sharding, tokencount, toxicity
from .common import documents



def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file: below ``TOKENIZER_DIR`` where that is set, else as the package of these files says."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))



def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_report(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return njaccard.near_duplicates(documents(spark, sf_dir), width=3, percent=90)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.expr(f"if(score >= {toxicity.THRESHOLD}, 1, 0)").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir)).drop("found")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_html": op3_html,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_lm_score": op6_lm_score,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_licences": op10_licences,
}
SQL: dict[str, str] = {"op2_ngram_jaccard": njaccard.SQL, "op5_sharding": sharding.SQL, "op7_quality": quality.SQL}

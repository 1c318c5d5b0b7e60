"""The corpus pipeline: quality rules, toxicity, near duplicates, decontamination, token encoding.

``run(spark, sf_dir)`` applies the stages to ``documents``; each stage's result
is written as Parquet to the shared folder and read again as the next one's
input. All stages but the last return the columns of ``documents``.

Defined cases, for every stage. A null text counts as empty; quality rules reject
it, the other stages keep it. Rows without an id, and rows that share one, are
judged each for itself, by their text. Exact repetitions of a row get the same
verdict; the third stage keeps one of them. Other columns, of any name, are kept as
they are and not read. Texts are read whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, decontam, njaccard, quality, toxicity
from orrery.llm.common import materialize
from orrery.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_filter(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group (shingles of five words, similarity 0.8 or more)."""
    return njaccard.keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's token count, and digests of its ids and of the text they decode to."""
    return bpe.bpe_round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_tokens),
]

#: Not expressible in SQL: the toxicity, retrieval and encoding stages. Tests hold each stage's rows against a plain version
#: of its verdicts, the toxicity model's own scores included.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and reads it back as the next one's docs.
A stage keeps all rows that it has no reason to drop and, but for the last, the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm import decontaminate, langid, ngram_join, packing, pii
from kinweave.llm.common import discard, docs_of, materialize, remainder
from kinweave.llm.queries import tokenizer_path

#: Documents without letters, or whose language stays open, go.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = langid.train(langid.training_words(docs, remainder(F.col("doc_id"), 3) != 1))
    found = langid.identify(docs, trees)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("PII", personal_data), ("packing", packed)]
#: SQL can't express the stages; tests/llm holds the operators that they call against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return docs

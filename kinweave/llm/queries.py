"""The queries of this subpackage: thin, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, imatch, langid, lm_scoring, ngram_join, packing, pii, sharding, suffix_dedup, token_counts
from .common import docs_of, remainder

#: Bytes of text in a shard of op4.
SHARD_BYTES = 4 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(docs_of(spark, sf_dir), remainder(F.col("doc_id"), 7) != 2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs_of(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(docs_of(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(docs_of(spark, sf_dir), SHARD_BYTES).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", "depth", "oversized")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(docs_of(spark, sf_dir), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 3) == 1
    trees = langid.train(langid.training_words(docs, ~held_out))
    return langid.identify(docs.select("doc_id", "text"), trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(docs_of(spark, sf_dir), tokenizer_path())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(docs_of(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(docs_of(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_suffix_dedup, op3_ngram_join, op4_sharding, op5_token_counts, op6_decontamination, op7_language_id, op8_packing, op9_pii, op10_fingerprints)}


#: The shortest prefix of 32 key bits whose documents fit; rows of one key (beyond 32 bits) don't occur in an oracle's table.
OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS a FROM documents),
p AS (SELECT doc_id, n, a, g.k AS depth, a >> (32 - g.k) AS prefix FROM d, generate_series(0, 32) AS g(k)),
s AS (SELECT depth, prefix, sum(n) AS b, count(*) AS r FROM p GROUP BY ALL HAVING sum(n) <= {SHARD_BYTES} OR count(*) = 1),
c AS (SELECT p.doc_id, any_value(p.n) AS n, any_value(p.a) AS a, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix) GROUP BY p.doc_id)
SELECT doc_id, n AS n_bytes, left(lpad(bin(a), 32, '0'), depth::INTEGER) AS shard, depth::INTEGER AS depth, n > {SHARD_BYTES} AS oversized FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": OP4_SQL}

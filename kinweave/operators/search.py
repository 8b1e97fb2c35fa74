"""Ranked name search."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import tokens


def normalize_query(q: str) -> str:
    q = re.sub(r"[,;]+", " ", q.lower().strip())
    q = re.sub(r"\bsenior\b", "sr", re.sub(r"\bjunior\b", "jr", q))
    return re.sub(r"\s+", " ", q).strip(" .,")


def tier(canonical: Column, aliases: Column, q: str) -> Column:
    """100 equal, 92 begins, 90 a word begins, 50 inside, 40 in an alias, else 20 + 5 for each query word that begins a word; null for none."""
    low, words, want = F.lower(canonical), tokens(F.lower(canonical)), F.lit(q)
    hits = F.lit(0)
    for part in q.split():
        hits = hits + F.exists(words, lambda x: x.startswith(F.lit(part))).cast("int")
    return (
        F.when(low == want, 100).when(low.startswith(want), 92).when(F.exists(words, lambda x: x.startswith(want)), 90).when(low.contains(want), 50)
        .when(F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: F.lower(x).contains(want)), 40).when(hits > 0, hits * 5 + 20)
    ).cast("double")


def search(index: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The best limit entries of an index, of each lower-cased canonical the first by name; queries under two letters find nothing."""
    q = normalize_query(query)
    if len(query.strip()) < 2:
        return index.limit(0).withColumn("score", F.lit(0.0))
    points = tier(F.col("canonical"), F.col("aliases"), q)
    points = points + F.when(F.col("degree") > 0, F.least(F.lit(15.0), F.log10(F.col("degree") + 1) * 4.0)).otherwise(0.0)
    rows = index.withColumn("score", points).where("score IS NOT NULL")
    row = F.struct(*index.columns, "score")
    rows = rows.groupBy(F.lower("canonical").alias("_k")).agg(F.min_by(row, F.col("canonical")).alias("r")).select("r.*")
    return rows.orderBy(F.desc("score"), F.desc("degree"), "canonical").limit(limit)

"""The driver's tables as relationships: customers and suppliers linked by order lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Relation type by order priority (first letter) and return flag; mirrored in SQL.
KINDS = {
    "1A": "DIRECTOR", "1N": "CEO", "1R": "SPOUSE", "2A": "OFFICER (CFO)", "2N": "EMPLOYED_BY", "2R": "DONATION", "3A": "MEMBER_OF", "3N": "ALUMNI_OF", "3R": "OWNERSHIP", "4A": "MENTIONED_WITH",
    "4N": "ADVISOR", "4R": "ALIAS", "5A": "LOBBYIST", "5N": "PAID_BY", "5R": "CHIEF_OF_STAFF",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order, cust, supp = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    rows = line.join(order, line.l_orderkey == order.o_orderkey).join(cust, order.o_custkey == cust.c_custkey).join(supp, line.l_suppkey == supp.s_suppkey)
    kind = F.coalesce(F.try_element_at(kinds, F.concat(F.substring("o_orderpriority", 1, 1), F.col("l_returnflag"))), F.lit("OTHER_TIE"))
    return rows.select(
        ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("ingest_seq"), F.col("c_custkey").cast("string").alias("source_id"), F.col("c_name").alias("source_name"), F.lit("PERSON").alias("source_type"),
        F.col("s_suppkey").cast("string").alias("target_id"), F.col("s_name").alias("target_name"), F.lit("COMPANY").alias("target_type"), kind.alias("relation_type"), F.col("o_orderstatus").alias("source_data"), F.lit(None).cast("string").alias("evidence"), F.col("l_quantity").alias("quantity"), F.year("o_orderdate").alias("year"),
    )


SQL = f"""rel AS (SELECT (l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey AS ingest_seq, c_custkey::VARCHAR AS source_id, c_name AS source_name, 'PERSON' AS source_type, s_suppkey::VARCHAR AS target_id, s_name AS target_name, 'COMPANY' AS target_type,
 CASE left(o_orderpriority, 1) || l_returnflag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'OTHER_TIE' END AS relation_type, o_orderstatus AS source_data, l_quantity AS quantity, year(o_orderdate) AS year
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""

"""Sinks: edge and cache upserts, replacement by source, graph, index and report files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.edges import first_writer


def insert_edges(rel: DataFrame, path: str) -> int:
    """Appends the rows of new triples; the first writer wins. Returns how many."""
    spark = rel.sparkSession
    new = first_writer(rel, _existing(spark, path)).cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) and fs.listStatus(p) else None


def upsert_cache(new: DataFrame, path: str) -> DataFrame:
    """Writes (key, payload, ts) with the last row of each key next to path's old rows and returns it."""
    old = _existing(new.sparkSession, path)
    last = last_of_key(new if old is None else old.unionByName(new))
    out, aside = f"{path.rstrip('/')}_next", f"{path.rstrip('/')}_old"
    last.write.mode("overwrite").parquet(out)
    p = new.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(new.sparkSession._jsc.hadoopConfiguration())
    # the old rows are moved, not deleted, before the new ones take their place: a crash in between loses nothing
    fs.delete(p(aside), True)
    if old is not None:
        fs.rename(p(path), p(aside))
    fs.rename(p(out), p(path))
    return new.sparkSession.read.parquet(path)


def last_of_key(rows: DataFrame) -> DataFrame:
    """The last row of each key by ts."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts")))).where("_n = 1").drop("_n")


def replace_source(rel: DataFrame, path: str) -> None:
    """Replaces the partitions of the sources that rel has, and no others."""
    first_writer(rel).write.mode("overwrite").partitionBy("source_data").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_graph(scored: DataFrame, path: str, json: bool = False) -> None:
    """Scored edges as Parquet, or as gzipped JSON lines with the probability rounded to four places."""
    if json:
        scored.withColumn("prob", F.bround("prob", 4)).write.mode("overwrite").option("compression", "gzip").json(path)
    else:
        scored.write.mode("overwrite").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    index.orderBy(F.lower("canonical")).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def gephi_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.coalesce("id", F.lit("")).alias("Id"), F.coalesce("id", F.lit("")).alias("Label"), F.coalesce("type", F.lit("PERSON")).alias("Type"))


def gephi_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target"), F.lit("Directed").alias("Type"), F.coalesce("relation", F.lit("ASSOCIATE")).alias("Relation"), F.coalesce("source", F.lit("SEC")).alias("DatasetSource"))


def _attr(c: str):
    out = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the lines of a GEXF file in order of part."""
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><gexf version="1.2"><graph defaultedgetype="directed"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s" label="%s"/>', _attr("id"), _attr("id")).alias("value"))
    e = edges.select(F.lit(3).alias("part"), F.format_string('<edge source="%s" target="%s" label="%s"/>', _attr("src"), _attr("dst"), _attr("relation")).alias("value"))
    return fixed.union(n).union(e)


def export_gephi(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    gephi_nodes(nodes).write.mode("overwrite").csv(f"{path}/nodes", header=True)
    gephi_edges(edges).write.mode("overwrite").csv(f"{path}/edges", header=True)
    gexf_lines(nodes, edges).orderBy("part").select("value").write.mode("overwrite").text(f"{path}/gexf")


def merge_deceased(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the names of new that it lacks and the dates of new for those it has; deaths before 1900 don't count, and an empty new is refused."""
    good = new.where("death_date >= '1900'")
    if good.isEmpty():
        raise ValueError("no new deaths: the old list stays")
    return old.join(good, "name_lower", "left_anti").unionByName(good)


def newly_dead(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.where("death_date >= '1900'").join(old, "name_lower", "left_anti")


def report(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent, ties by name."""
    return counts.orderBy(F.desc("appearances"), "canonical").limit(k)


def progress(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("found"), F.current_timestamp().alias("at"))

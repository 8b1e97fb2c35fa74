"""Graph operators over DataFrames: compile, degree, PageRank, percentile, neighbours, components."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import clean_name


def _shared(spark) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own on a single machine, and none on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="kinweave-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder, its partitions kept."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: computed once, where a checkpoint computes its last stage twice."""
    path = f"{_shared(df.sparkSession)}/kinweave/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compile_graph(rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed graph of cleaned names: nodes (id, type, ext_id) with the first known attributes, edges (src, dst, relation, source) of the last row."""
    rows = rel.select("ingest_seq", clean_name(F.col("source_name")).alias("src"), clean_name(F.col("target_name")).alias("dst"), "source_type", "target_type", "source_id", "target_id", "relation_type", "source_data").where("src <> '' AND dst <> ''")
    side = lambda k, n: rows.select("ingest_seq", F.lit(k).alias("side"), F.col("src" if n == "source" else "dst").alias("id"), F.col(f"{n}_type").alias("type"), F.col(f"{n}_id").alias("ext_id"))
    both = side(0, "source").union(side(1, "target"))
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct("ingest_seq", "side"))).alias(c)
    nodes = both.groupBy("id").agg(first("type"), first("ext_id"))
    edges = rows.groupBy("src", "dst").agg(F.max_by(F.struct(F.col("relation_type").alias("relation"), F.col("source_data").alias("source")), "ingest_seq").alias("e")).select("src", "dst", "e.relation", "e.source")
    return nodes, edges


def degree(scored: DataFrame) -> DataFrame:
    """(node, degree) of an undirected edge table."""
    return scored.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def directed_degree(rel: DataFrame) -> DataFrame:
    """(node, degree): rows in which a raw name stands on either side."""
    out = rel.groupBy(F.col("source_name").alias("node")).count().union(rel.groupBy(F.col("target_name").alias("node")).count())
    return out.where("node IS NOT NULL").groupBy("node").agg(F.sum("count").alias("degree"))


def neighbours(scored: DataFrame) -> DataFrame:
    both = scored.select("a", "b").union(scored.select(F.col("b"), F.col("a")))
    return both.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def pagerank(scored: DataFrame, alpha: float = 0.85, max_iter: int = 200, tol: float | None = 1e-6, cut_every: int = 8) -> DataFrame:
    """(node, rank): weighted PageRank of an undirected edge table; tol None runs exactly max_iter rounds. Every node has an edge, so no rank dangles."""
    arcs = scored.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("prob").alias("w")).union(scored.select("b", "a", "prob"))
    out = arcs.groupBy("u").agg(F.sum("w").alias("total"))
    arcs = checkpointed(arcs.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("w")).repartition("u"))
    nodes = checkpointed(out.select(F.col("u").alias("node")))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks, held = nodes.withColumn("rank", F.lit(1.0 / n)), None
    for i in range(1, max_iter + 1):
        new = arcs.join(ranks, arcs.u == ranks.node).groupBy(F.col("v").alias("node")).agg((F.lit((1 - alpha) / n) + F.lit(alpha) * F.sum(F.col("w") * F.col("rank"))).alias("rank"))
        if i % cut_every == 0 or i == max_iter:
            new = checkpointed(new)
            if tol is not None:
                before = held if held is not None else nodes.withColumn("rank", F.lit(1.0 / n))
                moved = new.join(before.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                # over cut_every rounds the change is at least that of the last one times their number, as it shrinks
                if moved < n * tol:
                    return new
            held = new
        ranks = new
    return ranks


def percentile(ranked: DataFrame, value: str = "rank", order: tuple[str, ...] = ("node",)) -> DataFrame:
    """ranked with sci: 1 to 100 by place in ascending order of value. Places come from counts of range partitions, not from one task."""
    n = ranked.count()
    by = [value, *order]
    parts = ranked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    parts = checkpointed(parts.withColumn("_p", F.shiftright("_id", 33)))
    sizes = parts.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))  # a row for each partition
    place = F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sci = F.greatest(F.lit(1), F.least(F.lit(100), F.rint(place / F.lit(max(n, 1)) * 100).cast("int")))
    return parts.join(F.broadcast(before), "_p").withColumn("sci", sci).drop("_id", "_p", "_b")


def without(scored: DataFrame, nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The subgraph without nodes (node), but for keep."""
    gone = nodes.where(~F.col("node").isin(*keep)) if keep else nodes
    return scored.join(gone, scored.a == gone.node, "left_anti").join(gone, scored.b == gone.node, "left_anti")


def resolve(names: DataFrame, canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node): a canonical match, then a name match (an alias gives its canonical), then the node itself without case; only graph nodes."""
    q = names.select("query", F.lower(F.trim("query")).alias("q"))
    n = nodes.select(F.col("node").alias("graph_node"), F.lower("node").alias("k"))
    tiers = [
        canonical.select(F.lower("canonical").alias("q"), F.lower("canonical").alias("k"), F.lit(1).alias("tier")),
        canonical.select(F.lower("name").alias("q"), F.lower("canonical").alias("k"), F.lit(2).alias("tier")),
        nodes.select(F.lower("node").alias("q"), F.lower("node").alias("k"), F.lit(3).alias("tier")),
    ]
    every = tiers[0].union(tiers[1]).union(tiers[2]).distinct().join(n, "k")
    best = q.join(every, "q").groupBy("query").agg(F.min_by("graph_node", F.struct("tier", "graph_node")).alias("node"))
    return q.select("query").join(best, "query", "left")


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable over pairs (a, b)."""
    edges = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        # a label is a node too: take its own label at once
        jump = step.alias("s").join(step.select(F.col("node").alias("l"), F.col("label").alias("ll")), F.col("s.label") == F.col("l"), "left")
        new = checkpointed(jump.select("node", F.least("label", F.coalesce("ll", "label")).alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def shards(df: DataFrame, n: int, order: str) -> DataFrame:
    """df with shard: place in order modulo n, from range partitions."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("_p", F.shiftright("_id", 33)))
    sizes = placed.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))
    return placed.join(F.broadcast(before), "_p").withColumn("shard", F.pmod(F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(n))).drop("_id", "_p", "_b")


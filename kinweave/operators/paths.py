"""The k most probable simple paths between two nodes.

Costs are -ln(p) - ln(forward), so the least cost is the likeliest path. h(node) is the least cost to the target over at most max_hops - 1 links without the source, found from the
target outwards, one link a round, from the nodes that the last round brought nearer. Each neighbour v of the source has a simple path of cost w + h(v), all of them different, so the
k-th least of these bounds the k-th best path; nodes that no path below the bound can use aren't followed. A frontier of partial paths then grows by one link a round over the links
that are left; what can't reach the target below the bound goes (strictly: ties stay). The result is exact for max_hops; exact says that it is so without that bound: k paths were
found and a longer one would cost more.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import FORWARD, band, edge_weight, forward, guided, one_in, primary, product
from .graph import written

#: Nodes up to which they go to the links instead of the links to them.
FEW = 100_000
FIELDS = "rank int, cost double, length int, path array<string>, exact boolean"


def _near(edges: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """(u, v, w, x) of the links at nodes (node, x), from either end: v is the node, u the other end."""
    if few:
        nodes = F.broadcast(nodes)
    there = edges.join(nodes, edges.b == nodes.node).select(F.col("a").alias("u"), F.col("b").alias("v"), "w", "x")
    return there.unionByName(edges.join(nodes, edges.a == nodes.node).select(F.col("b").alias("u"), F.col("a").alias("v"), "w", "x"))


def _within(cost, bound: float):
    return cost <= F.lit(bound * (1 + 1e-12) if bound < math.inf else 1e300)


def _reach(edges: DataFrame, source: str, target: str, k: int, max_hops: int) -> tuple[DataFrame, float]:
    """(node, h) of the nodes that a path below the bound may use, and the bound."""
    spark = edges.sparkSession
    first = written(_near(edges, spark.createDataFrame([(source, 0)], "node string, x int"), True).select(F.col("u").alias("node"), "w").where(F.col("node") != source))
    least = first.agg(F.min("w")).first()[0]
    reach = spark.createDataFrame([(target, 0.0)], "node string, h double")
    bound = math.inf
    if least is None:
        return reach, bound
    moved, n = reach, 1
    for hops in range(max_hops):
        # each neighbour of the source has a path of its own
        best = [r[0] for r in first.join(reach, "node").select((F.col("w") + F.col("h")).alias("c")).orderBy("c").limit(k).collect()]
        bound = best[-1] if len(best) == k else math.inf
        if hops == max_hops - 1:
            break
        step = _near(edges, moved.select("node", F.col("h").alias("x")), n <= FEW).where(F.col("u") != source).groupBy(F.col("u").alias("node")).agg(F.min(F.col("w") + F.col("x")).alias("new"))
        step = step.where(_within(F.col("new") + F.lit(least), bound)).join(reach, "node", "left")
        moved = written(step.where("h IS NULL OR new < h").select("node", F.col("new").alias("h")))
        n = moved.count()
        if not n:
            break
        reach = written(reach.unionByName(moved).groupBy("node").agg(F.min("h").alias("h")))
    return written(reach.where(_within(F.col("h") + F.lit(least), bound))), bound


def find_paths(scored: DataFrame, source: str, target: str, k: int = 5, max_hops: int = 6, exclude: DataFrame | None = None, cut: bool = True) -> DataFrame:
    """(rank, cost, length, path, exact); ties by path. Excluded nodes may still be the ends. No path: no rows. One node: a path of no link. cut: scored's lineage is cut first,
    as it is read several times; not needed for what is written."""
    from .graph import without

    source, target = source.lower().strip(), target.lower().strip()
    if source == target:
        here = scored.where((F.col("a") == source) | (F.col("b") == source)).limit(1)
        return here.select(F.lit(1).alias("rank"), F.lit(0.0).alias("cost"), F.lit(0).alias("length"), F.array(F.lit(source)).alias("path"), F.lit(True).alias("exact"))
    if exclude is not None:
        scored = without(scored, exclude, (source, target))
    edges = scored.select("a", "b", edge_weight(F.col("prob")).alias("w"))
    if cut:
        edges = written(edges)
    reach, bound = _reach(edges, source, target, k, max_hops)
    n = reach.count()
    # links towards what a path may use; h: of the end they lead to
    arcs = _near(edges, reach.withColumnRenamed("h", "x"), n <= FEW).withColumnRenamed("x", "h").where(F.col("v") != source)
    starts = reach.where(F.col("node") != target).select(F.col("node").alias("u")).unionByName(edges.sparkSession.createDataFrame([(source,)], "u string")).distinct()
    arcs = written(arcs.join(F.broadcast(starts) if n <= FEW else starts, "u", "left_semi"))
    front = edges.sparkSession.createDataFrame([(source, 0.0, [source])], "last string, cost double, path array<string>")
    done = None
    for _ in range(max_hops):
        grown = front.join(arcs, front["last"] == arcs.u).where(~F.array_contains("path", F.col("v"))).select(F.col("v").alias("last"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("v")).alias("path"), "h")
        grown = written(grown.where(_within(F.col("cost") + F.col("h"), bound)))
        ended = grown.where(F.col("last") == target).select("cost", "path")
        done = written((ended if done is None else done.union(ended)).orderBy("cost", "path").limit(k))
        worst, n = done.agg(F.max("cost"), F.count("*")).first()
        bound = min(bound, worst) if n >= k else bound
        front = grown.where(F.col("last") != target).drop("h")
        if front.isEmpty():
            break
    longer = -math.log(FORWARD) * (max_hops + 1)
    from pyspark.sql import Window

    full = n >= k and worst < longer
    return done.select(F.row_number().over(Window.orderBy("cost", "path")).alias("rank"), "cost", (F.size("path") - 1).alias("length"), "path", F.lit(full).alias("exact"))  # at most k rows


def describe(paths: DataFrame, scored: DataFrame, labels: DataFrame | None = None, deceased: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """One row for each path: probabilities, bands and labels, and its steps (node, label, relation, prob, cats, deceased, sci)."""
    step = paths.select("rank", F.posexplode("path").alias("i", "node"), "path").withColumn("prev", F.when(F.col("i") > 0, F.element_at("path", F.col("i").cast("int")))).drop("path")
    edge = scored.select(F.col("a"), F.col("b"), "prob", "cats")
    step = step.join(edge, (F.least("node", "prev") == edge.a) & (F.greatest("node", "prev") == edge.b), "left").drop("a", "b")
    if labels is not None:
        step = step.join(labels.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n"), "left").drop("_n")
    else:
        step = step.withColumn("label", F.lit(None).cast("string"))
    if deceased is not None:
        step = step.join(F.broadcast(deceased.select(F.col("name_lower").alias("_n"), F.col("death_date").alias("deceased"))), F.col("node") == F.col("_n"), "left").drop("_n")
    else:
        step = step.withColumn("deceased", F.lit(None).cast("string"))
    if index is not None:
        step = step.join(index.select(F.lower("canonical").alias("_n"), "sci"), F.col("node") == F.col("_n"), "left").drop("_n")
    else:
        step = step.withColumn("sci", F.lit(None).cast("int"))
    parts = F.struct("i", "node", F.coalesce("label", "node").alias("label"), primary(F.coalesce(F.col("cats"), F.array().cast("array<string>"))).alias("relation"), "prob", "cats", "deceased", "sci")
    rows = step.groupBy("rank").agg(F.array_sort(F.collect_list(parts)).alias("steps"))
    probs = F.filter(F.transform("steps", lambda x: x["prob"]), lambda x: x.isNotNull())
    hops = F.size("steps") - 1
    out = rows.select("rank", hops.alias("length"), product(probs).alias("link_prob"), forward(hops).alias("forward_prob"), guided(hops).alias("_g"), F.greatest(hops - 1, F.lit(0)).alias("n_relays"), "steps")
    p, g = F.col("link_prob") * F.col("forward_prob"), F.col("link_prob") * F.col("_g")
    return out.select("rank", "length", p.alias("probability"), "link_prob", "forward_prob", g.alias("guided_probability"), band(g).alias("guided_band"), one_in(g).alias("guided_prob_label"), "n_relays", F.lit(FORWARD).alias("forward_rate"), one_in(p).alias("prob_label"), band(p).alias("band"), F.col("steps").alias("path"))

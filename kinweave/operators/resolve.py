"""Entity resolution and the search indexes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import classify_basic, classify_index, flip_filing_name, fuzzy_last_name, is_fragment, is_obviously_bad, is_upper, normalize_name, tokens
from .graph import components


def _last_len(c: str):
    return F.length(F.coalesce(F.try_element_at(tokens(F.col(c)), F.lit(-1)), F.lit("")))


def alias_groups(names: DataFrame) -> DataFrame:
    """(norm, group): names (norm) that fuzzy surname rules tie within their first word, in either direction; group is the least of a cluster."""
    block = names.select("norm").distinct().withColumn("first", F.substring_index("norm", " ", 1))
    x, y = block.select("first", F.col("norm").alias("a")), block.select("first", F.col("norm").alias("b"))
    ties = x.join(y, "first").where("a < b").where(fuzzy_last_name(F.col("a"), F.col("b")) | fuzzy_last_name(F.col("b"), F.col("a"))).select("a", "b")
    found = components(ties)
    return block.join(found, block.norm == found.node, "left").select("norm", F.coalesce("label", "norm").alias("group"))


def canonical_map(nodes: DataFrame, overrides: DataFrame | None = None, boost_surnames: tuple[str, ...] = (), fuzzy: bool = True) -> DataFrame:
    """(node, canonical, name, type, is_alias, norm) of nodes (node); the canonical of a group has the longest surname, then ordinary case, then the shortest name.

    overrides (name, canonical) are taken name by name; boost_surnames are preferred.
    """
    rows = nodes.select("node", F.col("node").alias("name"), classify_basic(F.col("node")).alias("type"), normalize_name(F.col("node")).alias("norm")).where(~is_obviously_bad(F.col("node")) & ~is_fragment(F.col("node")))
    groups = alias_groups(rows) if fuzzy else rows.select("norm", F.col("norm").alias("group")).distinct()
    rows = rows.join(groups, "norm")
    bonus = F.when(F.lower("name").rlike("(?:" + "|".join(boost_surnames) + ")$"), 10).otherwise(0) if boost_surnames else F.lit(0)
    best = F.struct((F.length("name") > 3).alias("long"), (_last_len("name") + bonus).alias("last"), (~is_upper(F.col("name"))).alias("proper"), (-F.length("name")).alias("short"))
    chosen = rows.groupBy("group").agg(F.max_by("name", F.struct(best.alias("b"), "name")).alias("canonical"), F.bool_or(F.col("type") == "person").alias("_p"))
    out = rows.join(chosen, "group").select("node", "canonical", "name", "type", (F.col("name") != F.col("canonical")).alias("is_alias"), "norm")
    if overrides is not None:
        own = F.broadcast(overrides.select(F.col("name").alias("_n"), F.col("canonical").alias("_c")))
        out = out.join(own, out.name == F.col("_n"), "left").select("node", F.coalesce("_c", "canonical").alias("canonical"), "name", "type", F.when(F.col("_c").isNotNull(), False).otherwise(F.col("is_alias")).alias("is_alias"), "norm")
    return out


def dedup_index(canonical: DataFrame, degrees: DataFrame, least_location_degree: int = 5) -> DataFrame:
    """Search index of canonical groups: canonical, normalized, type, primary_node, all_nodes, aliases, count; rarely linked places go."""
    rows = canonical.join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rows = rows.where((F.col("type") != "location") | (F.col("degree") >= least_location_degree))
    out = rows.groupBy("canonical").agg(F.min("norm").alias("normalized"), F.when(F.bool_or(F.col("type") == "person"), "person").otherwise(F.min("type")).alias("type"), F.max_by("node", F.struct("degree", "node")).alias("primary_node"), F.array_sort(F.collect_set("node")).alias("all_nodes"), F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name")))).alias("aliases"), F.sum("degree").alias("count"))
    return out.orderBy(F.lower("canonical"))


def merge_first_names(index: DataFrame) -> DataFrame:
    """Second pass: within a first word, entries whose surname is like that of the best entry join it."""
    first, last = F.lower(F.element_at(tokens(F.col("canonical")), 1)), F.lower(F.element_at(tokens(F.col("canonical")), -1))
    rows = index.where("trim(canonical) <> ''").withColumn("_f", first).withColumn("_l", last)
    full = (F.size(tokens(F.col("canonical"))) >= 2) & (F.length("_l") >= 4)
    order = [F.desc(full.cast("int")), F.desc(F.when(full, F.length("_l")).otherwise(0)), F.when(full, F.col("count")).otherwise(0), F.lower("canonical"), "canonical"]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_f").orderBy(*order)))
    best = rows.where("_n = 1").select("_f", F.col("canonical").alias("_best"), F.col("_l").alias("_bl"))
    joins = (F.substring("_bl", 1, 3) == F.substring("_l", 1, 3)) | F.contains("_l", "_bl") | F.contains("_bl", "_l")
    rows = rows.join(best, "_f").withColumn("_to", F.when(joins, F.col("_best")).otherwise(F.col("canonical")))
    head = F.struct("canonical", "normalized", "type", "primary_node")
    out = rows.groupBy("_to").agg(F.max(F.struct((F.col("canonical") == F.col("_to")).alias("own"), head.alias("h"))).alias("m"), F.array_distinct(F.flatten(F.collect_list("all_nodes"))).alias("all_nodes"), F.array_union(F.flatten(F.collect_list("aliases")), F.collect_set("canonical")).alias("aliases"), F.sum("count").alias("count"))
    return out.select("m.h.*", F.array_sort("all_nodes").alias("all_nodes"), F.array_sort(F.filter("aliases", lambda x: x != F.col("_to"))).alias("aliases"), "count")


def alias_pairs(rel: DataFrame) -> DataFrame:
    """(node, alias) of ALIAS rows, both ways."""
    own = rel.where("relation_type = 'ALIAS'")
    return own.select(F.col("source_name").alias("node"), F.col("target_name").alias("alias")).union(own.select("target_name", "source_name")).distinct()


def raw_index(rel: DataFrame, degrees: DataFrame) -> DataFrame:
    """Search index of raw names: canonical, aliases, count, type, node; one entry for each canonical, with all aliases and the largest count."""
    nodes = rel.select(F.col("source_name").alias("node")).union(rel.select("target_name")).where("node IS NOT NULL AND trim(node) <> ''").distinct()
    aliases = alias_pairs(rel).groupBy("node").agg(F.collect_set("alias").alias("aliases"))
    rows = nodes.join(aliases, "node", "left").join(degrees, "node", "left").select("node", flip_filing_name(F.col("node")).alias("canonical"), classify_index(F.col("node")).alias("type"), F.coalesce("degree", F.lit(0)).alias("count"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    return rows.groupBy("canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.max("count").alias("count"), F.min_by("type", "node").alias("type"), F.min("node").alias("node"))


def scored_index(degrees: DataFrame, ranks: DataFrame, labels: DataFrame) -> DataFrame:
    """Search index of scored nodes: canonical, normalized, degree, sci, aliases."""
    rows = degrees.join(ranks.select("node", "sci"), "node").join(labels, "node", "left")
    return rows.select(F.coalesce("label", "node").alias("canonical"), F.col("node").alias("normalized"), "degree", "sci", F.array().cast("array<string>").alias("aliases"))


def compact_names(names: DataFrame) -> DataFrame:
    """(key, name): the shortest spelling, the first on ties; names: (name, seq)."""
    return names.where("trim(name) <> ''").groupBy(F.trim(F.lower("name")).alias("key")).agg(F.min_by("name", F.struct(F.length("name"), F.col("seq"))).alias("name"))

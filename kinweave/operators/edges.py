"""From raw relationships to scored pairs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.categories import category, normal
from ..functions.names import looks_like_person
from ..functions.scoring import BITS, noisy_or_bits, used_bits

# Fixed values.
DROPPED = ("FELLOW_REPRESENTATIVE", "FELLOW_SENATOR", "OWNERSHIP")
POSITIONS = "OWNERSHIP POSITION DIRECTOR CEO CHAIRMAN PRESIDENT BOARD_MEMBER BOARD_MEMBER_OF TRUSTEE OFFICER CFO COO PARTNER FOUNDER MEMBER MEMBERSHIP EXECUTIVE_VICE_PRESIDENT CHIEF_OF_STAFF SENIOR_VICE_PRESIDENT VICE_PRESIDENT GENERAL_COUNSEL MANAGING_DIRECTOR CHIEF_EXECUTIVE_OFFICER CHIEF_FINANCIAL_OFFICER INDEPENDENT_DIRECTOR CHAIR VICE_CHAIRMAN EXECUTIVE_CHAIRMAN LOBBYING LOBBYIST EMPLOYER".split()


def usable(source: Column, target: Column) -> Column:
    """Both ends there and not the same name."""
    return (F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "") & (source != target)


def persons(rel: DataFrame) -> DataFrame:
    """(person): lower-cased names that are a PERSON on either side."""
    side = lambda s: rel.where(F.col(f"{s}_type") == "PERSON").select(F.lower(f"{s}_name").alias("person"))
    return side("source").union(side("target")).where("person IS NOT NULL").distinct()


def clean(rel: DataFrame, drop_person_positions: bool = True) -> DataFrame:
    """Rows that count: usable ends, no dropped relation, and no position held at what is a person."""
    out = rel.where(usable(F.col("source_name"), F.col("target_name")) & ~F.coalesce(F.col("relation_type"), F.lit("")).isin(*DROPPED))
    if not drop_person_positions:
        return out
    known = persons(rel)
    for side in ("source", "target"):
        own = known.select(F.col("person").alias(f"_{side}"), F.lit(True).alias(f"_is_{side}"))
        out = out.join(own, F.lower(f"{side}_name") == F.col(f"_{side}"), "left").drop(f"_{side}")
    both = F.lit(True)
    for side in ("source", "target"):
        both = both & (F.coalesce(f"_is_{side}", F.lit(False)) | looks_like_person(F.col(f"{side}_name")))
    return out.where(~(F.coalesce(F.col("relation_type"), F.lit("")).isin(POSITIONS) & both)).drop("_is_source", "_is_target")


def clean_counts(rel: DataFrame) -> DataFrame:
    """Raw rows, and how many each rule drops first."""
    bad = ~usable(F.col("source_name"), F.col("target_name"))
    dropped = F.coalesce(F.col("relation_type"), F.lit("")).isin(*DROPPED)
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return rel.agg(F.count("*").alias("raw"), n(F.coalesce(bad, F.lit(True))).alias("bad_ends"), n(~F.coalesce(bad, F.lit(True)) & dropped).alias("dropped_relation"))


def _ends(rel: DataFrame) -> DataFrame:
    """(a, b, relation): lower-cased, a < b."""
    s, t = F.lower("source_name"), F.lower("target_name")
    return rel.select(F.least(s, t).alias("a"), F.greatest(s, t).alias("b"), F.col("relation_type").alias("relation")).where("a <> b")


def pair_relations(rel: DataFrame) -> DataFrame:
    """(a, b, relation): distinct, lower-cased, a < b."""
    return _ends(rel).distinct()


def with_overlaps(pairs: DataFrame, overlaps: DataFrame) -> DataFrame:
    """pairs and the overlap edges whose ends are both in them already."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    edge = overlaps.select(F.lower("a").alias("x"), F.lower("b").alias("y"), "rel").where("x <> y")
    edge = edge.join(nodes, edge.x == nodes.node, "left_semi").join(nodes, edge.y == nodes.node, "left_semi")
    return pairs.unionByName(edge.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("rel").alias("relation"))).distinct()


def score(pairs: DataFrame) -> DataFrame:
    """(a, b, prob, cats): one row for each pair with a category that counts."""
    pairs = pairs.select("a", "b", normal(F.col("relation")).alias("r"))
    found = pairs.groupBy("a", "b").agg(F.bit_or(category(F.col("r"), BITS)).alias("bits")).where("bits <> 0")
    return found.select("a", "b", noisy_or_bits(F.col("bits")).alias("prob"), used_bits(F.col("bits")).alias("cats"))


def scored_edges(rel: DataFrame, overlaps: DataFrame | None = None, drop_person_positions: bool = True) -> DataFrame:
    kept = clean(rel, drop_person_positions)
    return score(_ends(kept) if overlaps is None else with_overlaps(pair_relations(kept), overlaps))


def display_names(rel: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, label): the first spelling of each lower-cased name; nodes (node): only of these few."""
    both = rel.select("ingest_seq", F.lit(0).alias("side"), F.col("source_name").alias("n")).union(rel.select("ingest_seq", F.lit(1), "target_name"))
    if nodes is not None:
        both = both.join(F.broadcast(nodes), F.lower("n") == nodes.node, "left_semi")
    return both.where("n IS NOT NULL AND n <> ''").groupBy(F.lower("n").alias("node")).agg(F.min_by("n", F.struct("ingest_seq", "side")).alias("label"))


def first_writer(rel: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Idempotent insert: trimmed names, null as empty, the first row of each triple; none that existing has."""
    key = ["source_name", "target_name", "relation_type"]
    rows = rel.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in key[:2]})
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("ingest_seq"))).where("_n = 1").drop("_n")
    if existing is None:
        return rows
    have = existing.select(*(F.col(c).alias(f"_{c}") for c in key))
    return rows.join(have, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti")


def multi_category(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("pairs"), F.coalesce(F.sum((F.size("cats") > 1).cast("bigint")), F.lit(0)).alias("multi"))

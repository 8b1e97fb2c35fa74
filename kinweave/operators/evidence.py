"""Evidence for links, user contributions, and private matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import tokens

EVIDENCE_ITEMS = "array<struct<doc_id:string,snippet:string>>"


def truncate(evidence: Column) -> Column:
    """JSON of the first three items with snippets of 100 characters."""
    items = F.from_json(evidence, EVIDENCE_ITEMS)
    return F.to_json(F.transform(F.slice(items, 1, 3), lambda x: F.struct(x["doc_id"].alias("doc_id"), F.substring(x["snippet"], 1, 100).alias("snippet"))))


def update(rel: DataFrame, new: DataFrame, notes: dict[str, str] | None = None) -> DataFrame:
    """rel with evidence of new (source_name, target_name, relation_type, source_data, evidence); notes: text for relation types still without."""
    key = ["source_name", "target_name", "relation_type", "source_data"]
    own = new.groupBy(*key).agg(F.min("evidence").alias("_e"))
    out = rel.join(own, key, "left").withColumn("evidence", F.coalesce("_e", "evidence")).drop("_e")
    for relation, note in (notes or {}).items():
        out = out.withColumn("evidence", F.when(F.col("evidence").isNull() & (F.col("relation_type") == relation), F.to_json(F.struct(F.lit(note).alias("note")))).otherwise(F.col("evidence")))
    return out.select(*rel.columns)


def lookup(asked: DataFrame, evidence: DataFrame, attribution: DataFrame, directed: bool = True) -> DataFrame:
    """Evidence of each (src, tgt, rel) asked; without any, the attribution (rel, source, url) of its relation type; else none."""
    def key(df):
        s, t = F.lower("src"), F.lower("tgt")
        if not directed:
            s, t = F.least(s, t), F.greatest(s, t)
        return df.withColumn("_s", s).withColumn("_t", t)

    found = key(evidence).select("_s", "_t", F.col("rel").alias("_r"), F.struct("source", "snippet", "doc", "page", "url").alias("_e"))
    q = key(asked)
    q = q.join(found, (q._s == found._s) & (q._t == found._t) & (q.rel == found._r), "left").select("src", "tgt", "rel", "_e")
    a = F.broadcast(attribution.select(F.col("rel").alias("_r"), F.struct(F.col("source"), F.lit("").alias("snippet"), F.lit("").alias("doc"), F.lit("").alias("page"), F.col("url")).alias("_a")))
    return q.join(a, q.rel == F.col("_r"), "left").select("src", "tgt", "rel", F.coalesce("_e", "_a").alias("e")).where("e IS NOT NULL").select("src", "tgt", "rel", "e.*", )


def valid_claims(claims: DataFrame) -> DataFrame:
    """Claims within the length limits, pending."""
    limits = {"subject": (2, 100), "predicate": (2, 50), "object": (2, 100), "source_name": (2, 100), "snippet": (5, 1000)}
    ok = F.lit(True)
    for c, (a, b) in limits.items():
        ok = ok & F.coalesce(F.length(c).between(a, b), F.lit(False))
    return claims.where(ok).withColumn("status", F.lit("pending"))


def valid_disputes(disputes: DataFrame) -> DataFrame:
    return disputes.where(F.coalesce(F.length("edge_key").between(2, 250) & F.length("reason").between(5, 1000), F.lit(False))).withColumn("status", F.lit("pending"))


def salted(name: Column, salt: str) -> Column:
    return F.sha2(F.concat(name, F.lit(salt)), 256)


def private_matches(names: DataFrame, hashes: DataFrame, salt: str) -> DataFrame:
    """names whose salted hash was submitted."""
    return names.join(hashes.select(F.lower("hash").alias("_h")).distinct(), salted(F.col("name"), salt) == F.col("_h"), "left_semi")


def private_counts(names: DataFrame, hashes: DataFrame, salt: str) -> DataFrame:
    """(matches, total): graph names hit, and hashes submitted, repeats included; an empty salt or list gives zeros."""
    total = hashes.agg(F.count("*").alias("total"))
    if not salt:
        return total.select(F.lit(0).cast("bigint").alias("matches"), F.lit(0).cast("bigint").alias("total"))
    return private_matches(names, hashes, salt).agg(F.count("*").alias("matches")).join(total)


def contact_variants(contacts: DataFrame) -> DataFrame:
    """(contact, key): the lower-cased name, first and last word, and last and first."""
    t = tokens(F.lower("contact"))
    first, last = F.element_at(t, 1), F.element_at(t, -1)
    keys = F.when(F.size(t) >= 2, F.array(F.array_join(t, " "), F.concat_ws(" ", first, last), F.concat_ws(" ", last, first))).otherwise(F.array(F.array_join(t, " ")))
    return contacts.where("length(trim(contact)) > 3").select("contact", F.explode(F.array_distinct(keys)).alias("key"))


def match_contacts(contacts: DataFrame, names: DataFrame) -> DataFrame:
    """(contact, name): one best name for each contact: equal, else beginning with it at a word's end; shortest first."""
    keys, n = contact_variants(contacts), names.select("name", F.lower("name").alias("k"))
    exact = keys.join(n, keys.key == n.k).select("contact", "name", F.lit(0).alias("tier"), "k")
    # every beginning of a name that ends at a word's end: an equi-join in place of a comparison of all with all
    begins = n.withColumn("t", F.split("k", " ")).where("size(t) > 1").select("name", "k", F.explode(F.expr("transform(sequence(1, size(t) - 1), i -> array_join(slice(t, 1, i), ' '))")).alias("begin"))
    prefix = keys.join(begins, keys.key == begins.begin).select("contact", "name", F.lit(1).alias("tier"), "k")
    best = F.row_number().over(Window.partitionBy("contact").orderBy("tier", F.length("k"), "k", "name"))
    return exact.union(prefix).withColumn("_n", best).where("_n = 1").select("contact", "name")


def match_grantees(grantees: DataFrame, registry: DataFrame) -> DataFrame:
    """(grantee, ein): equal trimmed names, else the first ten letters inside the other's name, first by seq; registry: (name, ein, seq).

    The ten letters are met by their own grams, so nothing is compared with everything.
    """
    g = grantees.select("grantee", F.lower(F.trim("grantee")).alias("g")).distinct()
    r = registry.select("ein", "seq", F.lower(F.trim("name")).alias("r"))
    grams = lambda c: F.explode(F.expr(f"array_distinct(transform(sequence(1, greatest(length({c}) - 9, 1)), i -> substring({c}, i, 10)))"))
    exact = g.join(r, g.g == r.r).select("grantee", "ein", "seq", F.lit(0).alias("tier"))
    gin = g.withColumn("k", F.substring("g", 1, 10)).join(r.withColumn("k", grams("r")), "k").select("grantee", "ein", "seq", F.lit(1).alias("tier"))
    rin = g.withColumn("k", grams("g")).join(r.withColumn("k", F.substring("r", 1, 10)), "k").select("grantee", "ein", "seq", F.lit(1).alias("tier"))
    best = F.row_number().over(Window.partitionBy("grantee").orderBy("tier", "seq"))
    return exact.union(gin).union(rin).withColumn("_n", best).where("_n = 1").select("grantee", "ein")


def cross_connections(nodes: DataFrame, members: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(member, node): the first graph name that holds the member's name as whole words or is held by it; by word-run keys, not by comparing all."""
    runs = lambda df, c: df.withColumn("_t", tokens(F.lower(c))).where("size(_t) > 0").select(c, F.explode(F.expr("flatten(transform(sequence(1, size(_t)), i -> transform(sequence(i, least(size(_t), i + 5)), j -> array_join(slice(_t, i, j - i + 1), ' '))))")).alias("_k")).distinct()
    whole = lambda df, c: df.select(c, F.array_join(tokens(F.lower(c)), " ").alias("_k"))
    n, m = nodes.where(~F.col("node").isin(*exclude)) if exclude else nodes, members
    both = runs(n, "node").join(whole(m, "member"), "_k").select("member", "node").union(whole(n, "node").join(runs(m, "member"), "_k").select("member", "node"))
    return both.groupBy("member").agg(F.min("node").alias("node"))


def path_context(described: DataFrame) -> DataFrame:
    """(rank, context): the deterministic text of a path that a narrator would be given."""
    line = F.transform("path", lambda x: F.concat_ws(" ", x["label"], F.when(x["relation"].isNotNull(), F.concat(F.lit("["), x["relation"], F.lit("]")))))
    return described.select("rank", F.concat_ws("\n", line).alias("context"))

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import names as N
from ..functions.categories import categorize, categorize_sql, relation_info
from ..functions.roles import form4_relation
from ..functions.scoring import advantage, band, noisy_or_sql, one_in
from ..operators import edges as E, evidence as V, graph as G, pairs as P, paths as H, resolve as R, search as S
from ..streaming import ingest
from .crosswalk import SQL as REL, relationships as rel, table

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import rule_queries  # noqa: F401  (its queries register themselves)

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from . import rule_queries  # noqa: F401

    return dict(_SQL)


# Categories of one pair as a list, then its probability: the shared start of several queries in SQL.
_KEPT = "kept AS (SELECT * FROM rel WHERE relation_type NOT IN ('FELLOW_REPRESENTATIVE', 'FELLOW_SENATOR', 'OWNERSHIP') AND source_name <> target_name)"
_PAIRS = f"{REL}, {_KEPT}, pairs AS (SELECT DISTINCT least(lower(source_name), lower(target_name)) AS a, greatest(lower(source_name), lower(target_name)) AS b, relation_type AS relation FROM kept)"
_CATS = f"{_PAIRS}, cats AS (SELECT a, b, list(DISTINCT {categorize_sql('relation')}) AS l FROM pairs GROUP BY a, b)"
_SCORED = f"{_CATS}, scored AS (SELECT a, b, {noisy_or_sql('l')} AS prob, l FROM cats WHERE NOT (len(l) = 1 AND l[1] = 'SAME_ENTITY'))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scored_edges(rel(spark, sf_dir), drop_person_positions=False)


@query(f"WITH {REL} SELECT source_name, target_name, relation_type FROM rel")
def s1_edge_scan(spark, d):
    return rel(spark, d).select("source_name", "target_name", "relation_type")


@query(f"WITH {REL} SELECT count(*) AS raw, count(*) FILTER (source_name = target_name)::BIGINT AS bad_ends, count(*) FILTER (relation_type = 'OWNERSHIP' AND source_name <> target_name)::BIGINT AS dropped_relation FROM rel")
def a8_clean_counts(spark, d):
    return E.clean_counts(rel(spark, d))


@query(f"WITH {REL}, {_KEPT} SELECT relation_type, count(*) AS n FROM kept GROUP BY 1")
def p1_p2_clean(spark, d):
    return E.clean(rel(spark, d), drop_person_positions=False).groupBy("relation_type").agg(F.count("*").alias("n"))


@query(f"WITH {REL} SELECT relation_type, {categorize_sql('relation_type')} AS category, count(*) AS n FROM rel GROUP BY 1, 2")
def f9_categorize(spark, d):
    return rel(spark, d).groupBy("relation_type", categorize(F.col("relation_type")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def a1_pair_relations(spark, d):
    return E.pair_relations(E.clean(rel(spark, d), drop_person_positions=False))


@query(f"WITH {_SCORED} SELECT a, b, prob FROM scored")
def a2_noisy_or(spark, d):
    return scored(spark, d).select("a", "b", "prob")


@query(f"WITH {_SCORED} SELECT count(*) AS pairs, sum((len(list_filter(l, lambda c: c NOT IN ('CO_DIRECTOR','CO_EXECUTIVE','CO_OFFICER','EMPLOYMENT','SAME_ORG_OVERLAP','SEC_INSIDER','SAME_ENTITY'))) + (len(list_filter(l, lambda c: c IN ('CO_DIRECTOR','CO_EXECUTIVE','CO_OFFICER','EMPLOYMENT','SAME_ORG_OVERLAP','SEC_INSIDER'))) > 0)::INT > 1)::BIGINT)::BIGINT AS multi FROM scored")
def a3_a5_multi_category(spark, d):
    return E.multi_category(scored(spark, d))


@query(f"WITH {_SCORED} SELECT a, b, prob FROM scored ORDER BY prob DESC, a, b LIMIT 50")
def top_links(spark, d):
    return scored(spark, d).select("a", "b", "prob").orderBy(F.desc("prob"), "a", "b").limit(50)


@query(f"WITH {REL}, s AS (SELECT ingest_seq, 0 AS side, source_name AS n FROM rel UNION ALL SELECT ingest_seq, 1, target_name FROM rel) SELECT lower(n) AS node, arg_min(n, ingest_seq * 2 + side) AS label FROM s GROUP BY 1")
def a4_display_names(spark, d):
    return E.display_names(rel(spark, d))


@query(f"WITH {_SCORED} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM scored UNION ALL SELECT b FROM scored) GROUP BY 1")
def a6_degree(spark, d):
    return G.degree(scored(spark, d))


@query(f"WITH {REL} SELECT node, count(*)::BIGINT AS degree FROM (SELECT source_name AS node FROM rel UNION ALL SELECT target_name FROM rel) GROUP BY 1")
def a7_directed_degree(spark, d):
    return G.directed_degree(rel(spark, d)).withColumn("degree", F.col("degree").cast("bigint"))


@query("SELECT arg_min(p_name, length(p_name) * 1000000000 + p_partkey) AS name, trim(lower(p_name)) AS key FROM part WHERE trim(p_name) <> '' GROUP BY 2")
def a9_compact_names(spark, d):
    return R.compact_names(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")))


@query(f"WITH {_SCORED}, deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM scored UNION ALL SELECT b FROM scored) GROUP BY 1), o AS (SELECT node, degree, row_number() OVER (ORDER BY degree, node) - 1 AS i, count(*) OVER () AS n FROM deg) SELECT node, degree, greatest(1, least(100, round_even(i / n * 100, 0)::INT))::INT AS sci FROM o")
def w1_degree_percentile(spark, d):
    return G.percentile(G.degree(scored(spark, d)), "degree").select("node", "degree", "sci")


_ROUNDS = 8
_RANKS = ", ".join(f"r{i + 1} AS (SELECT v AS node, 0.15 / (SELECT n FROM size) + 0.85 * sum(w * r) AS r FROM arcs JOIN r{i} ON u = node GROUP BY v)" for i in range(_ROUNDS))


@query(f"WITH {_SCORED}, sym AS (SELECT a AS u, b AS v, prob AS w FROM scored UNION ALL SELECT b, a, prob FROM scored), arcs AS MATERIALIZED (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS w FROM sym), size AS (SELECT count(DISTINCT u)::DOUBLE AS n FROM arcs), r0 AS (SELECT DISTINCT u AS node, 1.0::DOUBLE / (SELECT n FROM size) AS r FROM arcs), {_RANKS} SELECT node, round(r * 1000, 7) AS rank FROM r{_ROUNDS}")
def g3_pagerank(spark, d):
    return G.pagerank(scored(spark, d), max_iter=_ROUNDS, tol=None).select("node", F.round(F.col("rank") * 1000, 7).alias("rank"))


@query()
def g3_pagerank_converged(spark, d):
    """Until no rank moves by more than the tolerance; g3_pagerank is the comparison of its rounds with SQL."""
    return G.pagerank(scored(spark, d)).select("node", "rank")


_ENDS = ("supplier#000000001", "supplier#000000002")
@query()
def g4_paths(spark, d):
    """Over all relationships; tests compare the search with enumeration on a small graph."""
    return H.find_paths(scored(spark, d), *_ENDS, k=5)


@query()
def d16_described_paths(spark, d):
    g = G.written(scored(spark, d))
    r = rel(spark, d)
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.lower("c_name").alias("name_lower"), F.lit("2001-01-01").alias("death_date"))
    found = H.find_paths(g, *_ENDS, k=5, exclude=gone.select(F.col("name_lower").alias("node")), cut=False)
    found = G.written(found)
    named = E.display_names(r, found.select(F.explode("path").alias("node")).distinct())
    return H.describe(found, g, named, gone).withColumn("advantage", advantage(F.col("probability"), F.col("guided_probability")))


@query(f"WITH {_SCORED}, gone AS (SELECT lower(c_name) AS node FROM customer WHERE c_acctbal < 0) SELECT a, b, prob FROM scored WHERE a NOT IN (SELECT node FROM gone) AND b NOT IN (SELECT node FROM gone)")
def p11_g5_living_only(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.lower("c_name").alias("node"))
    return G.without(scored(spark, d), gone).select("a", "b", "prob")


@query(f"WITH {REL}, e AS (SELECT source_name AS src, target_name AS dst, arg_max(relation_type, ingest_seq) AS relation, arg_max(source_data, ingest_seq) AS source FROM rel GROUP BY 1, 2) SELECT * FROM e")
def g1_compile(spark, d):
    return G.compile_graph(rel(spark, d))[1]


@query(f"WITH {_SCORED}, sym AS (SELECT a, b FROM scored UNION ALL SELECT b, a FROM scored) SELECT a AS node, array_to_string(list_sort(list(DISTINCT b)), ',') AS neighbours FROM sym GROUP BY 1")
def g7_neighbours(spark, d):
    return G.neighbours(scored(spark, d)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


def _affiliations(spark, d):
    line, order, cust, supp = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    rows = line.join(order, line.l_orderkey == order.o_orderkey).join(cust, order.o_custkey == cust.c_custkey).join(supp, line.l_suppkey == supp.s_suppkey)
    y = F.year("o_orderdate")
    rows = rows.groupBy(F.col("c_name").alias("person"), F.when(F.col("l_returnflag") == "A", "P69").otherwise("P108").alias("prop"), F.concat("s_name", F.lit("/"), "o_orderpriority").alias("org")).agg(F.min(y).alias("start_year"), F.when(F.count("*") > 1, F.max(y)).alias("end_year"))
    return rows.withColumn("org_label", F.col("org"))


@query(
    """WITH aff AS (SELECT c_name AS person, CASE WHEN l_returnflag = 'A' THEN 'P69' ELSE 'P108' END AS prop, s_name || '/' || o_orderpriority AS org, min(year(o_orderdate)) AS s, CASE WHEN count(*) > 1 THEN max(year(o_orderdate)) END AS e
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
 b AS (SELECT person, prop, org, coalesce(s, e - 8) AS s, coalesce(e, s + 8) AS e FROM aff),
 p AS (SELECT CASE WHEN x.prop = 'P108' THEN 'SAME_ORG_OVERLAP' ELSE 'SAME_SCHOOL_OVERLAP' END AS rel, greatest(x.s, y.s) AS s, least(x.e, y.e) AS e FROM b x JOIN b y ON x.prop = y.prop AND x.org = y.org AND x.person < y.person WHERE x.e - x.s <= 50 AND y.e - y.s <= 50 AND greatest(x.s, y.s) <= least(x.e, y.e))
 SELECT rel, count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM p GROUP BY 1"""
)
def j4_f18_overlap(spark, d):
    return P.overlap_totals(_affiliations(spark, d))


def _patents(spark, d):
    line, order, supp, cust = (table(spark, d, n) for n in ("lineitem", "orders", "supplier", "customer"))
    rows = line.join(supp, line.l_suppkey == supp.s_suppkey).join(order, line.l_orderkey == order.o_orderkey).join(cust, order.o_custkey == cust.c_custkey)
    return rows.select(F.col("l_orderkey").alias("patent_number"), F.year("o_orderdate").alias("grant_year"), F.concat("c_name", F.lit(" Inc")).alias("assignee"), F.col("s_name").alias("inventor"), F.col("s_name").alias("canonical"))


@query("WITH p AS (SELECT DISTINCT l_orderkey AS k, s_name AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT x.s AS a, y.s AS b, count(*) AS patent_count FROM p x JOIN p y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2")
def j5_a10_co_inventors(spark, d):
    return P.co_inventors(_patents(spark, d)).select("a", "b", "patent_count")


@query("SELECT s_name AS inventor, c_name || ' Inc' AS assignee, count(DISTINCT l_orderkey) AS patent_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def a10_assignees(spark, d):
    return P.assignees(_patents(spark, d))


@query("WITH n AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS patents, sum(n)::BIGINT AS inventors, sum(n * (n - 1) // 2)::BIGINT AS pairs FROM n")
def a12_pair_estimate(spark, d):
    return P.pair_estimate(_patents(spark, d))


@query("WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9'' -]', ' ', 'g'), '\\s+', ' ', 'g'), ' .,') AS norm, p_name FROM part) SELECT norm, arg_min(p_name, p_partkey) AS canonical, count(*) AS collisions FROM n WHERE norm <> '' GROUP BY 1")
def j2_a13_name_lookup(spark, d):
    return P.name_lookup(table(spark, d, "part").select(F.col("p_name").alias("node"), F.col("p_partkey").alias("seq")))


@query("WITH m AS (SELECT DISTINCT ts::DATE || '/' || json_extract_string(props, '$.k') AS article, user_id::VARCHAR AS p FROM events) SELECT x.p AS a, y.p AS b, count(*) AS n FROM m x JOIN m y ON x.article = y.article AND x.p < y.p GROUP BY 1, 2")
def j6_co_mentions(spark, d):
    ev = table(spark, d, "events").select(F.concat_ws("/", F.to_date("ts").cast("string"), F.get_json_object("props", "$.k")).alias("article"), F.col("user_id").cast("string").alias("person"))
    return P.co_mentions(ev, ev.select(F.col("person").alias("name")).distinct())


@query(f"WITH {_SCORED} SELECT CASE WHEN prob >= 0.5 THEN 'Strong' WHEN prob >= 0.1 THEN 'Plausible' WHEN prob >= 0.01 THEN 'Weak' ELSE 'Tenuous' END AS band, CASE WHEN prob >= 0.5 THEN round_even(prob * 100, 0)::BIGINT || '%' ELSE '≈ 1 in ' || round_even(1 / prob, 0)::BIGINT END AS label, count(*) AS n FROM scored GROUP BY 1, 2")
def f19_f20_bands(spark, d):
    return scored(spark, d).groupBy(band(F.col("prob")).alias("band"), one_in(F.col("prob")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name || ' Co., Ltd.' AS raw, p_name AS clean FROM part")
def f1_clean_name(spark, d):
    p = table(spark, d, "part")
    raw = F.concat("p_name", F.lit(" Co., Ltd."))
    return p.select("p_partkey", raw.alias("raw"), N.clean_name(raw).alias("clean"))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'A' THEN 'DIRECTOR (' || l_linestatus || ')' WHEN l_returnflag = 'N' THEN 'OFFICER (' || l_linestatus || ')' ELSE 'TEN_PERCENT_OWNER (' || l_linestatus || ')' END AS relation, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def f10_form4_relation(spark, d):
    flag = F.col("l_returnflag")
    r = form4_relation(flag == "A", flag == "N", flag == "R", F.col("l_linestatus"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", r.alias("relation")).agg(F.count("*").alias("n"))


_ASKED = "customer#00000001"


@query(
    f"""WITH {_SCORED}, deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM scored UNION ALL SELECT b FROM scored) GROUP BY 1),
 s AS (SELECT node AS canonical, degree, CASE WHEN node = '{_ASKED}' THEN 100 WHEN starts_with(node, '{_ASKED}') THEN 92 WHEN contains(node, '{_ASKED}') THEN 50 END + least(15.0::DOUBLE, log10(degree + 1) * 4.0) AS score FROM deg)
 SELECT canonical, degree, round(score, 9) AS score FROM s WHERE score IS NOT NULL ORDER BY s.score DESC, degree DESC, canonical LIMIT 50"""
)
def o1_f22_search(spark, d):
    index = G.degree(scored(spark, d)).select(F.col("node").alias("canonical"), "degree", F.array().cast("array<string>").alias("aliases"))
    return S.search(index, _ASKED).select("canonical", "degree", F.round("score", 9).alias("score"))


@query("WITH h AS (SELECT sha256(s_name || 'salt') AS h FROM supplier UNION ALL SELECT sha256(c_name || 'pepper') FROM customer) SELECT (SELECT count(*) FROM supplier WHERE sha256(s_name || 'salt') IN (SELECT h FROM h)) AS matches, (SELECT count(*) FROM h) AS total")
def j15_a17_private_counts(spark, d):
    supp, cust = table(spark, d, "supplier"), table(spark, d, "customer")
    hashes = supp.select(V.salted(F.col("s_name"), "salt").alias("hash")).union(cust.select(V.salted(F.col("c_name"), "pepper")))
    return V.private_counts(supp.select(F.col("s_name").alias("name")), hashes, "salt")


@query(f"WITH {REL} SELECT source_name AS src, target_name AS tgt, relation_type AS rel, 'order ' || source_data AS source, ingest_seq::VARCHAR AS doc FROM rel WHERE relation_type = 'SPOUSE' UNION ALL SELECT source_name, target_name, 'CEO', 'registry', '' FROM (SELECT DISTINCT source_name, target_name FROM rel WHERE relation_type = 'CEO')")
def j11_evidence(spark, d):
    r = rel(spark, d)
    have = r.where("relation_type = 'SPOUSE'").select(F.col("source_name").alias("src"), F.col("target_name").alias("tgt"), F.col("relation_type").alias("rel"), F.concat(F.lit("order "), "source_data").alias("source"), F.lit("").alias("snippet"), F.col("ingest_seq").cast("string").alias("doc"), F.lit("").alias("page"), F.lit("").alias("url"))
    asked = r.where("relation_type IN ('SPOUSE', 'CEO', 'DONATION')").select(F.col("source_name").alias("src"), F.col("target_name").alias("tgt"), F.col("relation_type").alias("rel")).distinct()
    names = spark.createDataFrame([("CEO", "registry", "")], "rel string, source string, url string")
    return V.lookup(asked, have, names).select("src", "tgt", "rel", "source", "doc")


@query(f"WITH {REL}, n AS (SELECT *, row_number() OVER (PARTITION BY source_name, target_name, relation_type ORDER BY ingest_seq) AS k FROM rel) SELECT ingest_seq, source_name, target_name, relation_type FROM n WHERE k = 1")
def t1_first_writer(spark, d):
    return E.first_writer(rel(spark, d)).select("ingest_seq", "source_name", "target_name", "relation_type")


@query("SELECT lower(c_name) AS name_lower, '2001-01-01' AS death_date FROM customer WHERE c_acctbal < 0 AND c_nationkey >= 5")
def j13_newly_dead(spark, d):
    from ..sources.sinks import newly_dead

    gone = lambda c: table(spark, d, "customer").where(c).select(F.lower("c_name").alias("name_lower"), F.lit("2001-01-01").alias("death_date"))
    return newly_dead(gone("c_acctbal < 0 AND c_nationkey < 5"), gone("c_acctbal < 0"))


@query(f"WITH {REL}, k AS (SELECT relation_type, count(*) AS n FROM rel GROUP BY 1) SELECT relation_type, n FROM k ORDER BY n DESC, relation_type LIMIT 5")
def o3_most_common(spark, d):
    return rel(spark, d).groupBy("relation_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation_type").limit(5)


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def w5_first_filings(spark, d):
    return P.first_per_group(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", 3).select("l_orderkey", "l_linenumber")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r1_event_windows(spark, d):
    return ingest.co_mention_windows(table(spark, d, "events")).select("start", "event_type", "n").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey)) - 1) % 4 AS shard FROM customer")
def r4_shards(spark, d):
    return G.shards(table(spark, d, "customer").select("c_custkey"), 4, "c_custkey")


@query()
def g9_canonical_map(spark, d):
    return R.canonical_map(table(spark, d, "part").select(F.initcap("p_name").alias("node")).distinct())


@query(f"WITH {REL}, k AS (SELECT DISTINCT relation_type FROM rel) SELECT relation_type, CASE relation_type WHEN 'DIRECTOR' THEN 'Director' WHEN 'CEO' THEN 'CEO' WHEN 'EMPLOYED_BY' THEN 'Employment' WHEN 'DONATION' THEN 'Donation' WHEN 'MEMBER_OF' THEN 'Member' WHEN 'ALUMNI_OF' THEN 'Alumnus' WHEN 'MENTIONED_WITH' THEN 'Co-mentioned in News' WHEN 'PAID_BY' THEN 'Financial Payment' ELSE relation_type END AS title FROM k")
def d18_relation_info(spark, d):
    return relation_info(rel(spark, d).select("relation_type").distinct())

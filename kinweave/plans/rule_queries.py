"""Queries of the name, role and source rules: names and payloads are made of the driver's columns, and SQL tells what the rules must find in them."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import names as N, roles as Z
from ..functions.categories import PROBABILITY, categorize, categorize_sql, category_info
from ..functions.scoring import forward, guided, primary, product
from ..operators import edges as E, evidence as V, graph as G, pairs as P, resolve as R
from ..sources import files, filings, sinks, web
from ..streaming import ingest
from .crosswalk import SQL as REL, relationships as rel, table
from .queries import _CATS, _patents, query, scored

#: Names of many shapes, in words that both engines read alike.
RAW = """CASE p_partkey % 20 WHEN 0 THEN 'Mr ' || p_name || ' Inc' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' 42' WHEN 3 THEN 'The ' || p_name || ' foundation' WHEN 4 THEN p_name || ' (old)'
 WHEN 5 THEN 'Dr ' || p_name || ' Lee' WHEN 6 THEN 'Ann ' || p_name || ' x' WHEN 7 THEN 'Great university of ' || p_name WHEN 8 THEN 'Fine ' || p_name || ' products and services' WHEN 9 THEN '(555) 010-' || lpad(CAST(p_partkey AS VARCHAR(9)), 4, '0')
 WHEN 10 THEN upper(left(p_name, 1)) || substr(p_name, 2) WHEN 11 THEN 'SMITH JOHN ' || upper(p_name) WHEN 12 THEN 'Big ' || p_name || ' house' WHEN 13 THEN 'Abc' WHEN 14 THEN 'Ann-Marie ' || upper(left(p_name, 1)) || substr(p_name, 2) || 'son, Jr.' WHEN 15 THEN 'A lot of the ' || p_name
 WHEN 16 THEN 'Big ' || p_name || ' Holdings' WHEN 17 THEN 'Smith, ' || p_name WHEN 18 THEN '' ELSE 'Extraordinarilylongword ' || p_name END"""


def raw_names(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(RAW.replace("AS VARCHAR(9)", "AS STRING")).alias("name"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_NAMES = f"n AS (SELECT p_partkey, {RAW} AS name FROM part), w AS (SELECT *, list_filter(string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM n), k AS (SELECT *, trim(lower(name)) AS low, len(t) AS n, coalesce(t[-1], '') AS last, coalesce(t[1], '') AS first FROM w)"
_ORG_PARTS = _list(N.ORG_PARTS)


@query(f"WITH {_NAMES} SELECT p_partkey, NOT regexp_matches(name, '(?i)\\b({N.ORG_WORDS})\\b') AND NOT regexp_matches(name, '[0-9]') AND n BETWEEN 2 AND 3 AS person, NOT regexp_matches(name, '(?i)\\b({N.ORG_WORDS_RESOLVER})\\b') AND NOT regexp_matches(name, '[0-9]') AND n BETWEEN 2 AND 4 AS person_like, regexp_matches(name, '(?i)\\b({N.ORG_WORDS_PATENT})\\b') AS org FROM k")
def p4_p5_p12_persons(spark, d):
    n = F.col("name")
    return raw_names(spark, d).select("p_partkey", N.looks_like_person(n).alias("person"), N.person_like(n).alias("person_like"), N.looks_org(n).alias("org"))


@query(
    f"""WITH {_NAMES} SELECT p_partkey, CASE WHEN name = '' THEN 'unknown' WHEN regexp_matches(low, '^[0-9() -]{{7,}}$') THEN 'location' WHEN list_has_any(string_split(low, ' '), {_list(N.LOCATION_WORDS)}) THEN 'location' WHEN low LIKE '%foundation' OR low LIKE '%trust' THEN 'org' WHEN low LIKE 'the %' THEN 'org' ELSE 'person' END AS basic,
 CASE WHEN n <= 1 THEN 'person' WHEN list_contains({_list(N.COMPANY_ENDS)}, lower(last)) THEN 'company' WHEN list_has_any(t, {_ORG_PARTS}) THEN 'organization' WHEN len(list_filter(t, lambda x: NOT regexp_matches(x, '^[A-Z]') AND x <> '&')) = 0 AND regexp_matches(last, '^[A-Z]') THEN 'person' ELSE 'entity' END AS kind,
 CASE WHEN n = 0 THEN true WHEN n = 1 AND len(first) <= 3 THEN true WHEN n >= 2 AND len(last) = 1 THEN true WHEN n >= 2 AND len(last) <= 3 THEN NOT list_contains({_list(N.SHORT_SURNAMES)}, lower(last)) ELSE len(list_filter(t, lambda x: len(x) > 15)) > 0 END AS fragment FROM k"""
)
def p6_p7_p8_classes(spark, d):
    n = F.col("name")
    return raw_names(spark, d).select("p_partkey", N.classify_basic(n).alias("basic"), N.classify_index(n).alias("kind"), N.is_fragment(n).alias("fragment"))


@query(
    f"""WITH {_NAMES} SELECT p_partkey, CASE WHEN trim(name) = '' THEN true WHEN regexp_matches(trim(name), '^[0-9()\\- ]+$') THEN true WHEN regexp_matches(trim(name), '^[a-z]') THEN true WHEN list_has_any(string_split(low, ' '), {_ORG_PARTS}) THEN false
 WHEN {' OR '.join(f"contains(low, '{x}')" for x in N.BAD_PHRASES)} THEN true WHEN list_contains({_list(N.NON_NAMES)}, lower(last)) AND n > 3 THEN true WHEN n = 1 AND list_contains({_list(N.NON_NAMES)}, lower(last)) THEN true WHEN n > 6 THEN true
 WHEN list_contains({_list(N.STARTERS)}, split_part(low, ' ', 1)) AND n > 1 THEN true WHEN regexp_matches(name, '[#/]') AND NOT regexp_matches(name, '[A-Za-z]') THEN true WHEN len(name) - len(replace(name, ',', '')) = 1 AND len(list_filter(string_split(split_part(trim(name), ',', 1), ' '), lambda x: x <> '')) <= 2 THEN true ELSE false END AS bad FROM k"""
)
def p9_obviously_bad(spark, d):
    return raw_names(spark, d).select("p_partkey", N.is_obviously_bad(F.col("name")).alias("bad"))


@query(
    f"""WITH {_NAMES}, a AS (SELECT p_partkey, trim(regexp_replace(trim(lower(name)), '\\(.*?\\)', '', 'g'), '.,;:()[]''" ') AS plain FROM n), b AS (SELECT *, list_filter(string_split(plain, ' '), lambda x: x <> '') AS t FROM a),
 c AS (SELECT *, t[coalesce(list_position(list_transform(t, lambda x: list_contains({_list(N.TITLES)}, x)), false), len(t) + 1):] AS u FROM b), e AS (SELECT *, u[:len(u) + 1 - coalesce(list_position(list_transform(list_reverse(u), lambda x: list_contains({_list(N.SUFFIXES)}, x)), false), len(u) + 1)] AS v FROM c)
 SELECT p_partkey, CASE WHEN len(list_filter(v, lambda x: NOT list_contains({_list(N.NOISE)}, x))) > 0 THEN array_to_string(list_filter(v, lambda x: NOT list_contains({_list(N.NOISE)}, x)), ' ') ELSE plain END AS norm FROM e"""
)
def f2_normalize_name(spark, d):
    return raw_names(spark, d).select("p_partkey", N.normalize_name(F.col("name")).alias("norm"))


@query(
    f"""WITH {_NAMES} SELECT p_partkey, CASE WHEN n >= 2 AND upper(first) = first AND lower(first) <> first AND len(first) > 1 AND len(list_filter(t, lambda x: NOT regexp_matches(x, '^[A-Za-z]'))) = 0
 THEN array_to_string(list_append(list_transform(t[2:], lambda x: upper(x[1]) || lower(x[2:])), upper(first[1]) || lower(first[2:])), ' ') ELSE name END AS flipped, trim(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g')) AS resolver_norm, replace(replace(replace(upper(name), ' ', '_'), '.', ''), ',', '') AS slug,
 NOT (upper(name) = name AND lower(name) <> name) AND n >= 2 AND len(first) > 2 AND NOT first LIKE '%.' AS real_name FROM k"""
)
def f6_f7_f15_p16_spellings(spark, d):
    n = F.col("name")
    return raw_names(spark, d).select("p_partkey", N.flip_filing_name(n).alias("flipped"), N.resolver_norm(n).alias("resolver_norm"), N.slug(n).alias("slug"), N.real_name(n).alias("real_name"))


_NOISY = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' - OAP x' WHEN 1 THEN ' Ssn' WHEN 2 THEN ' Air Force' WHEN 3 THEN ' (late)' WHEN 4 THEN '; ' ELSE '' END"


@query("SELECT p_partkey, p_name AS clean FROM part")
def f3_clean_extraction(spark, d):
    return table(spark, d, "part").select("p_partkey", N.clean_extraction_name(F.expr(_NOISY)).alias("clean"))


_SURNAMES = "CASE c_custkey % 12 WHEN 0 THEN 'johnson' WHEN 1 THEN 'johnston' WHEN 2 THEN 'johnsonbaugh' WHEN 3 THEN 'lee' WHEN 4 THEN 'leeds' WHEN 5 THEN 'jostonberg' WHEN 6 THEN 'jonson' WHEN 7 THEN 'johns' WHEN 8 THEN 'joveston-' WHEN 9 THEN 'smithson' WHEN 10 THEN 'smith' ELSE 'smithers' END"
_PEOPLE = f"CASE c_nationkey % 3 WHEN 0 THEN 'ann ' WHEN 1 THEN 'annabel ' ELSE 'bob ' END || {_SURNAMES}"


@query(
    f"""WITH p AS (SELECT DISTINCT {_PEOPLE} AS name FROM customer), q AS (SELECT x.name AS a, y.name AS b, split_part(x.name, ' ', 1) AS fa, split_part(y.name, ' ', 1) AS fb, rtrim(split_part(x.name, ' ', 2), '-') AS l1, rtrim(split_part(y.name, ' ', 2), '-') AS l2 FROM p x JOIN p y ON x.name <> y.name)
 SELECT a, b FROM q WHERE CASE WHEN fa[:3] <> fb[:3] THEN false WHEN len(l1) <= 4 OR len(l2) <= 4 THEN l1 = l2 WHEN starts_with(l1, l2) OR starts_with(l2, l1) THEN true WHEN l1[:4] = l2[:4] THEN abs(len(l1) - len(l2)) <= 3 WHEN l1[:2] = l2[:2] THEN len(list_filter(range(1, len(l1) - 2), lambda i: contains(l2, substr(l1, i::INT, 4)))) > 0 ELSE false END"""
)
def f4_fuzzy_surnames(spark, d):
    p = table(spark, d, "customer").select(F.expr(_PEOPLE).alias("a")).distinct()
    return p.join(p.withColumnRenamed("a", "b"), (F.col("a") != F.col("b")) & (F.substring("a", 1, 3) == F.substring("b", 1, 3))).where(N.fuzzy_last_name(F.col("a"), F.col("b")))


_TITLES = "CASE p_partkey % 11 WHEN 0 THEN 'Managing Partner' WHEN 1 THEN 'MD, Europe' WHEN 2 THEN 'Vice President' WHEN 3 THEN 'Partner' WHEN 4 THEN 'Chief Executive' WHEN 5 THEN 'Chief Financial Lead' WHEN 6 THEN 'COO' WHEN 7 THEN 'Compliance Officer' WHEN 8 THEN 'Board Observer' WHEN 9 THEN 'Member' ELSE 'Analyst' END"


@query("SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'GENERAL_PARTNER' WHEN 1 THEN 'MANAGING_DIRECTOR' WHEN 2 THEN 'EXECUTIVE_OFFICER' WHEN 3 THEN 'MANAGING_DIRECTOR' WHEN 4 THEN 'CEO' WHEN 5 THEN 'CFO' WHEN 6 THEN 'COO' WHEN 7 THEN 'EXECUTIVE_OFFICER' WHEN 8 THEN 'DIRECTOR' WHEN 9 THEN 'CONTROL_PERSON' ELSE 'OTHER_CONTROL' END AS relation FROM part")
def f12_title_relation(spark, d):
    return table(spark, d, "part").select("p_partkey", Z.adv_relation(F.expr(_TITLES)).alias("relation"))


_ROLES = "CASE p_partkey % 5 WHEN 0 THEN 'Director' WHEN 1 THEN 'isExecutiveOfficer' WHEN 2 THEN 'Promoter' WHEN 3 THEN 'General Counsel' ELSE 'Executive Officer' END"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'DIRECTOR' WHEN 1 THEN 'OFFICER' WHEN 2 THEN 'PROMOTER' WHEN 3 THEN 'GENERAL COUNSEL' ELSE 'OFFICER' END || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_D' END AS relation FROM part")
def f11_offering_roles(spark, d):
    return table(spark, d, "part").select("p_partkey", Z.form_d_relation(F.expr(_ROLES), F.when(F.col("p_size") % 2 == 0, "SEC_FORM_D").otherwise("SEC_D")).alias("relation"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'FOUNDER' WHEN 2 THEN 'CEO' WHEN 3 THEN 'CO_DIRECTOR' WHEN 4 THEN 'FAMILY' ELSE 'ASSOCIATE' END AS property, CASE l_linenumber WHEN 5 THEN 'EMPLOYED_BY' WHEN 6 THEN 'EDUCATED_AT' ELSE 'AFFILIATED' END AS role, CASE l_linenumber WHEN 5 THEN 'ORGANIZATION' WHEN 6 THEN 'INSTITUTION' ELSE 'RELATED' END AS kind,
 CASE l_returnflag WHEN 'A' THEN 'MET_WITH' WHEN 'N' THEN 'PAID_BY' ELSE 'R' END AS document, CASE l_linestatus WHEN 'F' THEN 'PERSON' ELSE 'UNKNOWN' END AS node, lpad(l_orderkey::VARCHAR, 10, '0') AS cik, replace('0-' || l_orderkey || '-1', '-', '') AS accession, 'f' || l_partkey || '.xml' AS document_name, 1990 + l_linenumber AS year,
 CASE WHEN l_suppkey % 3 = 0 THEN 'FINANCIAL_FIRM' ELSE 'VC_FIRM' END AS fund, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE 0.0 END::DOUBLE AS pay FROM lineitem"""
)
def f13_f14_f16_f17_f29_f31_roles(spark, d):
    line = table(spark, d, "lineitem")
    props = F.expr("'http://x/entity/' || element_at(array('P112', 'P169', 'P3320', 'P26', 'P108', 'P69', 'P9'), l_linenumber)")
    return line.select(
        "l_orderkey", "l_linenumber", Z.property_relation(props).alias("property"), Z.claim_role(props).alias("role"), Z.claim_type(props).alias("kind"),
        Z.document_relation(F.expr("CASE l_returnflag WHEN 'A' THEN 'MET' WHEN 'N' THEN 'PAID' ELSE 'R' END")).alias("document"), Z.document_type(F.expr("CASE l_linestatus WHEN 'F' THEN 'Person' ELSE 'Thing' END")).alias("node"),
        Z.pad_cik(F.expr("' ' || l_orderkey")).alias("cik"), Z.accession(F.expr("'0-' || l_orderkey || '-1'")).alias("accession"), Z.basename(F.expr("'xsl/a/f' || l_partkey || '.xml'")).alias("document_name"), Z.year(F.expr("(1990 + l_linenumber) || '-01-01T00:00:00Z'")).alias("year"),
        Z.fund_type(F.expr("CASE WHEN l_suppkey % 3 = 0 THEN 'Large Buyout' WHEN l_suppkey % 3 = 1 THEN 'Venture' END")).alias("fund"), Z.compensation(F.expr("CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity AS STRING) ELSE 'n/a' END")).alias("pay"),
    )


_PRIMARY = " ".join(f"WHEN list_contains(l, '{c}') THEN '{c}'" for c in sorted(PROBABILITY, key=lambda c: (-PROBABILITY[c], c)))


@query(f"WITH {_CATS} SELECT a, b, CASE {_PRIMARY} END AS relation FROM cats WHERE NOT (len(l) = 1 AND l[1] = 'SAME_ENTITY')")
def f26_primary_relation(spark, d):
    return scored(spark, d).select("a", "b", primary(F.col("cats")).alias("relation"))


@query("SELECT l_orderkey, l_linenumber, round(1.0::DOUBLE * l_discount * l_tax * 0.5::DOUBLE, 12) AS link, round(pow(0.37::DOUBLE, l_linenumber - 1), 12) AS forward, round(CASE WHEN l_linenumber <= 1 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE * pow(0.6::DOUBLE, l_linenumber - 2) END, 12) AS guided FROM lineitem")
def a18_f24_f25_path_products(spark, d):
    hops = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(product(F.array("l_discount", "l_tax", F.lit(0.5))), 12).alias("link"), F.round(forward(hops), 12).alias("forward"), F.round(guided(hops), 12).alias("guided"))


# Positions between persons: every third target is a person by its name.
_TARGET = "CASE WHEN p_partkey % 3 = 0 THEN 'Jane ' || p_name WHEN p_partkey % 3 = 1 THEN p_name || ' Holdings' ELSE 'Acme 7' END"
_REL2 = f"rel2 AS (SELECT rel.* EXCLUDE (target_name), {_TARGET} AS target_name FROM rel JOIN part ON p_partkey = ingest_seq % 1000000)"


@query(f"WITH {REL}, {_REL2} SELECT relation_type, target_name, count(*) AS n FROM rel2 WHERE relation_type NOT IN ('FELLOW_REPRESENTATIVE', 'FELLOW_SENATOR', 'OWNERSHIP') AND NOT (list_contains({_list(E.POSITIONS)}, relation_type) AND target_name LIKE 'Jane %' ) GROUP BY ALL")
def p3_j8_u2_person_positions(spark, d):
    r = rel(spark, d)
    part = table(spark, d, "part").select("p_partkey", F.expr(_TARGET).alias("_t"))
    r = r.join(part, F.col("ingest_seq") % 1000000 == part.p_partkey).withColumn("target_name", F.col("_t")).drop("_t", "p_partkey")
    return E.clean(r).groupBy("relation_type", "target_name").agg(F.count("*").alias("n"))


@query(f"WITH {REL}, p AS (SELECT DISTINCT lower(source_name) AS a, lower(target_name) AS b, relation_type AS relation FROM rel WHERE relation_type = 'SPOUSE'), nodes AS (SELECT a AS n FROM p UNION SELECT b FROM p), o AS (SELECT DISTINCT lower(x.c_name) AS a, lower(y.c_name) AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1) SELECT a, b, relation FROM p UNION SELECT a, b, 'SAME_ORG_OVERLAP' FROM o WHERE a IN (SELECT n FROM nodes) AND b IN (SELECT n FROM nodes)")
def j3_u5_overlaps_of_known(spark, d):
    cust = table(spark, d, "customer")
    pairs = E.pair_relations(rel(spark, d).where("relation_type = 'SPOUSE'"))
    over = cust.select(F.col("c_name").alias("a"), (F.col("c_custkey") + 1).alias("k")).join(cust.select(F.col("c_name").alias("b"), F.col("c_custkey").alias("k")), "k").select("b", F.col("a"), F.lit("SAME_ORG_OVERLAP").alias("rel"))
    return E.with_overlaps(pairs, over)


_PAYLOADS = "o AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN '4' WHEN 'O' THEN 'D' ELSE '10-K' END AS form, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth, count(*) OVER (PARTITION BY o_custkey) AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"


def _submissions(spark, d) -> DataFrame:
    """Submission lists by customer; the list of documents lacks the last."""
    form = F.expr("CASE o_orderstatus WHEN 'F' THEN '4' WHEN 'O' THEN 'D' ELSE '10-K' END")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))).alias("r"))
    doc = F.expr("slice(transform(r, x -> 'xsl/' || x.o_orderkey || '.xml'), 1, size(r) - 1)")
    recent = F.struct(F.col("r.form").alias("form"), F.expr("transform(r, x -> '0-' || x.o_orderkey || '-1')").alias("accessionNumber"), F.col("r.day").alias("filingDate"), doc.alias("primaryDocument"))
    good = rows.select(F.col("o_custkey").cast("string").alias("cik"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    return good.union(spark.range(3).select(F.col("id").cast("string"), F.lit('{"filings": {"recent": ')))


@query(f"WITH {_PAYLOADS} SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, form, '0' || o_orderkey || '1' AS accession, day AS filing_date, CASE WHEN nth < k - 1 THEN o_orderkey || '.xml' END AS document, nth::INT AS nth FROM o WHERE form IN ('4', 'D')")
def s2_submissions(spark, d):
    return filings.submissions(_submissions(spark, d), ("4", "D"))


@query(f"WITH {_PAYLOADS} SELECT o_custkey::VARCHAR AS cik, form, count(*) AS n FROM o GROUP BY ALL")
def a15_form_histogram(spark, d):
    return filings.form_histogram(_submissions(spark, d))


@query("SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS cik, s_name AS title FROM supplier")
def s20_company_ciks(spark, d):
    one = F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), F.struct(F.col("s_suppkey").cast("string").alias("cik_str"), F.col("s_name").alias("title")))))
    return filings.company_ciks(table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(one).alias("payload")))


@query(
    """SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS issuer_cik, s_name AS issuer, s_nationkey::VARCHAR AS owner_cik, 'Owner ' || s_suppkey AS owner, s_suppkey % 4 = 0 AS is_director, s_suppkey % 4 = 1 AS is_officer, s_suppkey % 4 = 2 AS is_ten_percent, CASE WHEN s_suppkey % 3 = 0 THEN 'CFO' ELSE '' END AS title,
 CASE s_suppkey % 4 WHEN 0 THEN 'DIRECTOR' WHEN 1 THEN 'OFFICER' WHEN 2 THEN 'TEN_PERCENT_OWNER' ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'OFFICER' ELSE 'INSIDER' END END || CASE WHEN s_suppkey % 3 = 0 THEN ' (CFO)' ELSE '' END AS relation FROM supplier WHERE s_suppkey % 10 NOT IN (7, 8, 9)"""
)
def s3_ownership_filings(spark, d):
    """Each tenth filing has an unescaped mark, crossed tags, or no owner's name: these give none."""
    k = F.col("s_suppkey")
    name = F.when(k % 10 == 7, F.lit("A & B")).when(k % 10 == 8, F.lit("<b><i>x</b></i>")).when(k % 10 == 9, F.lit("")).otherwise(F.concat(F.lit("Owner "), k))
    text = F.format_string(
        '<SEC>\n<XML>\n<?xml version="1.0"?>\n<ns:ownershipDocument xmlns:ns="urn:x"><issuer><issuerCik>%010d</issuerCik><issuerName>%s</issuerName></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>%d</rptOwnerCik><rptOwnerName>%s</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>%s</isDirector><isOfficer>%s</isOfficer><isTenPercentOwner>%s</isTenPercentOwner><officerTitle>%s</officerTitle></reportingOwnerRelationship></reportingOwner></ns:ownershipDocument>\n</XML>',
        k, F.col("s_name"), F.col("s_nationkey"), name, F.when(k % 4 == 0, "1").otherwise("0"), F.when(k % 4 == 1, "true").otherwise("false"), F.when(k % 4 == 2, "1").otherwise(""), F.when(k % 3 == 0, "CFO").otherwise(""),
    )
    return filings.form4(table(spark, d, "supplier").select(text.alias("payload")))


@query("SELECT s_name AS issuer, lpad(s_suppkey::VARCHAR, 10, '0') AS issuer_cik, 'Ann ' || s_name AS person, r AS role, CASE r WHEN 'Promoter' THEN 'PROMOTER' ELSE 'DIRECTOR' END || '_D' AS relation FROM supplier, (VALUES ('Promoter'), ('isDirector')) t(r) WHERE r = 'Promoter' OR s_suppkey % 2 = 0")
def s4_offering_filings(spark, d):
    text = F.format_string(
        '<edgarSubmission><primaryIssuer><cik>%d</cik><entityName>%s</entityName></primaryIssuer><relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>Ann</firstName><lastName>%s</lastName></relatedPersonName><relatedPersonRelationshipList><relationship>Promoter</relationship></relatedPersonRelationshipList><relationshipDetails><isDirector>%s</isDirector></relationshipDetails></relatedPersonInfo></relatedPersonsList></edgarSubmission>',
        F.col("s_suppkey"), F.col("s_name"), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "true").otherwise("false"),
    )
    return filings.form_d(table(spark, d, "supplier").select(text.alias("payload")))


@query("SELECT s_name AS filer, 'Ann ' || s_suppkey AS name, 'Chair' AS title, s_nationkey::DOUBLE AS compensation FROM supplier WHERE s_suppkey % 5 <> 0")
def s5_u7_nonprofit_officers(spark, d):
    """One person in two spellings counts once; each fifth return is malformed."""
    group = "<Grp><PersonNm>%s %d</PersonNm><TitleTxt>Chair</TitleTxt><ReportableCompFromOrgAmt>%d</ReportableCompFromOrgAmt></Grp>"
    k, pay = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.format_string(f'<Return xmlns="urn:x"><Filer><BusinessName><BusinessNameLine1Txt>%s</BusinessNameLine1Txt></BusinessName></Filer>{group}{group}</Return>%s', F.col("s_name"), F.lit("Ann"), k, pay, F.lit("ANN"), k, pay + 1, F.when(k % 5 == 0, "</x>").otherwise(""))
    return filings.nonprofit_officers(table(spark, d, "supplier").select(text.alias("payload")))


@query("SELECT DISTINCT p_brand AS grantee FROM part")
def s5_grantees(spark, d):
    text = F.format_string('<Return xmlns="urn:x"><GrantOrContributionPdDurYrGrp><RecipientBusinessName><BusinessNameLine1Txt> %s </BusinessNameLine1Txt></RecipientBusinessName></GrantOrContributionPdDurYrGrp></Return>', F.col("p_brand"))
    return filings.grantees(table(spark, d, "part").select(text.alias("payload")))


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Unknown VC Firm' END AS firm, 'Ann ' || s_suppkey AS owner, 'Board Chair' AS title, 'DIRECTOR' AS relation FROM supplier UNION ALL SELECT s_name, 'Bob ' || s_suppkey, 'GP', 'GENERAL_PARTNER' FROM supplier")
def s6_adviser_owners(spark, d):
    supp = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    xml = F.format_string("%s<ScheduleA><Owner><IndividualName>Ann %d</IndividualName><Title>Board Chair</Title></Owner></ScheduleA>", F.when(k % 2 == 0, F.format_string("<LegalName>%s</LegalName>", F.col("s_name"))).otherwise(""), k)
    json = F.to_json(F.struct(F.col("s_name").alias("firm_name"), F.array(F.struct(F.format_string("Bob %d", k).alias("fullName"), F.lit("GP").alias("position"))).alias("control_persons")))
    return filings.adviser_owners(supp.select(xml.alias("payload"))).union(filings.adviser_firm_owners(supp.select(json.alias("payload"))))


@query("SELECT 'Fund ' || s_nationkey AS pension_fund, s_name AS fund_name, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey ELSE 0 END::BIGINT AS amount, CASE WHEN s_suppkey % 2 = 0 THEN 2001 ELSE 0 END::INT AS vintage_year, CASE WHEN s_suppkey % 2 = 0 THEN 'Buyout' WHEN s_suppkey % 4 = 1 THEN 'Growth' ELSE '' END AS asset_class FROM supplier WHERE s_suppkey % 7 <> 0")
def s7_commitments(spark, d):
    """Amounts with a comma or letters are 0; assetclass is taken before asset_class."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        F.format_string(" Fund %d ", F.col("s_nationkey")).alias("pensionfund"), F.when(k % 7 == 0, " ").otherwise(F.col("s_name")).alias("fund_name"), F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "1,000").otherwise("n/a").alias("commitmentamount"),
        F.when(k % 2 == 0, "2001").alias("vintage_year"), F.when(k % 2 == 0, "Buyout").otherwise("").alias("assetclass"), F.when(k % 4 == 1, "Growth").when(k % 4 == 0, "Other").otherwise("").alias("asset_class"),
    )
    return files.commitments(rows)


_GRAPH = "e AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Location' ELSE 'Organization' END AS sk, CASE l_orderkey % 2 WHEN 0 THEN 'Location' ELSE 'Person' END AS tk, CASE l_returnflag WHEN 'A' THEN 'MET_WITH' WHEN 'N' THEN 'EMPLOYED_BY' ELSE 'R' END AS rel, l_quantity / 50 AS confidence FROM lineitem)"


@query(f"WITH {_GRAPH} SELECT 's' || l_orderkey || '/' || l_linenumber AS source_name, upper(sk) AS source_type, 't' || l_orderkey AS target_name, upper(tk) AS target_type, rel AS relation_type, confidence::DOUBLE AS confidence FROM e WHERE confidence >= 0.9 AND NOT (sk = 'Location' AND tk = 'Location')")
def s9_j1_p14_document_graph(spark, d):
    line = table(spark, d, "lineitem")
    source, target = F.format_string("s%d/%d", "l_orderkey", "l_linenumber"), F.format_string("t%d", "l_orderkey")
    nodes = line.select(source.alias("node_id"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Location' ELSE 'Organization' END").alias("node_type")).distinct().union(line.select(target, F.expr("CASE l_orderkey % 2 WHEN 0 THEN 'Location' ELSE 'Person' END")).distinct())
    edges = line.select(F.expr("CASE l_returnflag WHEN 'A' THEN 'MET' WHEN 'N' THEN 'EMPLOYED' ELSE 'R' END").alias("edge_type"), source.alias("source_label"), target.alias("target_label"), (F.col("l_quantity") / 50).cast("double").alias("confidence"), source.alias("source_node_id"), target.alias("target_node_id"))
    return files.document_graph(nodes, edges)


@query("WITH i AS (SELECT DISTINCT p_partkey, lower(x) AS inventor FROM (SELECT p_partkey, unnest([p_name, p_brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END]) AS x FROM part) WHERE trim(x) <> '') SELECT inventor, count(*) AS patents FROM i GROUP BY 1")
def s11_a11_inventors(spark, d):
    wide = table(spark, d, "part").select(F.col("p_partkey").alias("patent_number"), F.lit(2001).alias("grant_year"), F.lit("x").alias("assignee"), F.lit(3).alias("team_size"), F.col("p_name").alias("inventor_name1"), F.col("p_brand").alias("inventor_name2"), F.expr("CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END").alias("inventor_name3"))
    return P.unpivot_inventors(wide).select("patent_number", F.lower("inventor").alias("inventor")).distinct().groupBy("inventor").agg(F.count("*").alias("patents"))


@query("SELECT l_orderkey::VARCHAR AS k, 'Box ' || l_linenumber AS value, 'title' AS kind FROM lineitem WHERE l_linenumber <= 3 UNION SELECT l_orderkey::VARCHAR, 'School ' || l_suppkey, 'education' FROM lineitem WHERE l_linenumber <= 3")
def s12_infobox(spark, d):
    rows = table(spark, d, "lineitem").where("l_linenumber <= 3")
    text = F.format_string("intro\n{{Infobox officeholder\n| name = x\n| office = [[a|Box %d]]\n| alma_mater = [[School %d|short]], city\n}}\nrest", "l_linenumber", "l_suppkey")
    return web.infobox(rows.select(F.col("l_orderkey").cast("string").alias("name"), text.alias("text"))).select(F.col("name").alias("k"), "value", "kind").distinct()


@query("SELECT s_name AS firm, 'Ann Bo' || chr((97 + s_suppkey % 26)::INT) || 'er' AS partner FROM supplier UNION SELECT s_name, 'Carl D.' FROM supplier WHERE false UNION SELECT s_name, 'Jane Doe' FROM supplier WHERE s_suppkey % 2 = 0")
def s13_partners(spark, d):
    letter = F.char((F.lit(97) + F.col("s_suppkey") % 26).cast("long"))
    html = F.concat(F.lit("<table><tr><th scope='row'>Key people</th>\n<td><b>Ann Bo"), letter, F.lit("er</b>, CPA Smith; x, lower case"), F.when(F.col("s_suppkey") % 2 == 0, ", <a href='#'>Jane Doe</a>").otherwise(""), F.lit("</td></tr></table>"))
    return web.partners(table(spark, d, "supplier").select(F.col("s_name").alias("firm"), html.alias("html")))


def _sparql(spark, d) -> DataFrame:
    value = lambda c: F.struct(c.alias("value"))
    rows = table(spark, d, "customer").withColumn("g", F.col("c_nationkey"))
    row = F.struct(value(F.col("c_name")).alias("personLabel"), value(F.concat(F.lit("http://x/"), F.element_at(F.array(*map(F.lit, ("P112", "P169", "P26", "P9"))), (F.col("c_custkey") % 4 + 1).cast("int")))).alias("prop"), value(F.col("c_mktsegment")).alias("firmLabel"), value(F.lit("2001-02-03T00:00:00Z")).alias("death"), value(F.concat(F.lit("http://x/entity/Q"), "c_custkey")).alias("person"), value(F.lit("http://x/Q1")).alias("org"), value(F.col("c_mktsegment")).alias("orgLabel"), value(F.lit("1990-01-01")).alias("start"))
    return rows.groupBy("g").agg(F.to_json(F.struct(F.struct(F.collect_list(row).alias("bindings")).alias("results"))).alias("payload"))


@query("SELECT c_name AS source_name, c_mktsegment AS target_name, CASE c_custkey % 4 WHEN 0 THEN 'FOUNDER' WHEN 1 THEN 'CEO' WHEN 2 THEN 'FAMILY' ELSE 'ASSOCIATE' END AS relation_type FROM customer")
def s14_key_people(spark, d):
    return web.key_people(_sparql(spark, d))


@query("SELECT 'Q' || c_custkey AS person, ['P112', 'P169', 'P26', 'P9'][(c_custkey % 4 + 1)::INT] AS prop, 'Q1' AS org, c_mktsegment AS org_label, 1990::INT AS start_year, NULL::INT AS end_year FROM customer")
def s14_u3_affiliations(spark, d):
    return web.affiliations(_sparql(spark, d))


@query("SELECT lower(c_name) AS name_lower, '2001-02-03' AS death_date FROM customer")
def s14_deaths(spark, d):
    return web.deaths(_sparql(spark, d))


@query("SELECT s_name AS name, 'Label ' || s_suppkey AS target_name, CASE s_suppkey % 3 WHEN 0 THEN 'ORGANIZATION' WHEN 1 THEN 'INSTITUTION' ELSE 'RELATED' END AS target_type, CASE s_suppkey % 3 WHEN 0 THEN 'EMPLOYED_BY' WHEN 1 THEN 'EDUCATED_AT' ELSE 'STUDENT' END AS relation_type FROM supplier")
def s15_claims(spark, d):
    value = lambda c: F.struct(c.alias("value"))
    k = F.col("s_suppkey")
    good = F.struct(value(F.concat(F.lit("http://x/"), F.element_at(F.array(*map(F.lit, ("P108", "P69", "P802"))), (k % 3 + 1).cast("int")))).alias("prop"), value(F.concat(F.lit("Label "), k)).alias("valLabel"))
    short = F.struct(value(F.lit("http://x/P108")).alias("prop"), value(F.lit("short")).alias("valLabel"))
    return web.claims(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.to_json(F.struct(F.struct(F.array(good, short).alias("bindings")).alias("results"))).alias("payload")))


@query("SELECT least(s_name, 'n' || s_nationkey) AS a, greatest(s_name, 'n' || s_nationkey) AS b, (s_suppkey % 10) / 10.0::DOUBLE AS prob, 'FAMILY' AS cats FROM supplier")
def s17_graph_file(spark, d):
    rows = table(spark, d, "supplier")
    text = F.format_string('{"nodes": ["%s", "n%d"], "edges": [[0, 1, 0.%d, ["FAMILY"]]]}', "s_name", "s_nationkey", F.col("s_suppkey") % 10)
    return files.scored_graph(rows.select(text.alias("payload"))).select("a", "b", "prob", F.array_join("cats", ",").alias("cats"))


@query("SELECT lower(s_name) AS name_lower, '20' || lpad((s_suppkey % 20)::VARCHAR, 2, '0') || '-01-02' AS death_date FROM supplier")
def s18_deceased(spark, d):
    date = F.format_string("20%02d-01-02", F.col("s_suppkey") % 20)
    return files.deceased(table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("s_name", date)))).alias("payload")).union(spark.range(1).select(F.lit(1), F.lit("{bad"))))


@query("SELECT s_name AS src, 'n' || s_nationkey AS tgt, 'CEO' AS rel, 'file' AS source, 'note ' || s_suppkey AS snippet, s_suppkey::VARCHAR AS doc, '' AS page, 'u' AS url FROM supplier")
def s23_evidence_index(spark, d):
    item = F.array(F.struct(F.lit("file").alias("source"), F.concat(F.lit("note "), "s_suppkey").alias("snippet"), F.col("s_suppkey").cast("string").alias("doc"), F.lit("").alias("page"), F.lit("u").alias("url")))
    one = F.to_json(F.create_map(F.concat("s_name", F.lit("|n"), "s_nationkey", F.lit("|CEO")), item))
    return files.evidence_index(table(spark, d, "supplier").select(one.alias("payload")))


@query("SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'Ann ' || c_name ELSE c_name || ' Lee' END AS contact FROM customer")
def s22_contacts(spark, d):
    lines = table(spark, d, "customer").select(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'FN:' || c_name WHEN 1 THEN 'N;x=1:' || c_name || ';Ann;;' ELSE c_name || ', Lee,x' END").alias("value"))
    return files.contact_lines(lines.union(lines.select(F.lit("EMAIL:a,b")).limit(1)))


@query("WITH f AS (SELECT DISTINCT o_orderdate::DATE AS day, 'f' || (o_orderkey % 7) AS file FROM orders), m AS (SELECT date_trunc('month', day)::DATE AS month, file, row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY file) AS n, count(*) OVER (PARTITION BY date_trunc('month', day)) AS k FROM f WHERE day(day) = 15), a AS (SELECT date_trunc('month', day)::DATE AS month, arg_min(file, strftime(day, '%Y%m%d') || file) AS first FROM f GROUP BY 1) SELECT a.month, coalesce(m.file, a.first) AS file FROM a LEFT JOIN m ON a.month = m.month AND n = k // 2 + 1")
def s24_sampled_files(spark, d):
    return files.sampled_files(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.concat(F.lit("f"), F.col("o_orderkey") % 7).alias("file")).distinct())


@query("SELECT s_suppkey AS k, s_name || ' new' AS payload FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1")
def t2_last_writer(spark, d):
    supp = table(spark, d, "supplier")
    old = supp.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("payload"), F.lit(1).alias("ts"))
    return sinks.last_of_key(old.union(supp.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat("s_name", F.lit(" new")), F.lit(2)))).select(F.col("key").alias("k"), "payload")


@query(f"WITH {REL} SELECT ingest_seq, CASE WHEN relation_type = 'SPOUSE' THEN 'proof ' || source_data WHEN relation_type = 'CEO' THEN '{{\"note\":\"list\"}}' END AS evidence FROM rel")
def t4_evidence_update(spark, d):
    r = rel(spark, d)
    new = r.where("relation_type = 'SPOUSE'").select("source_name", "target_name", "relation_type", "source_data", F.concat(F.lit("proof "), "source_data").alias("evidence"))
    return V.update(r, new, {"CEO": "list"}).select("ingest_seq", "evidence")


@query("SELECT s_name AS \"Source\", 'n' || s_nationkey AS \"Target\", 'Directed' AS \"Type\", CASE WHEN s_suppkey % 2 = 0 THEN 'CEO' ELSE 'ASSOCIATE' END AS \"Relation\", 'SEC' AS \"DatasetSource\" FROM supplier")
def t9_export_edges(spark, d):
    edges = table(spark, d, "supplier").select(F.col("s_name").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.when(F.col("s_suppkey") % 2 == 0, "CEO").alias("relation"), F.lit(None).cast("string").alias("source"))
    return sinks.gephi_edges(edges)


@query("SELECT lower(c_name) AS name_lower, CASE WHEN c_custkey % 2 = 0 THEN '2002-01-01' ELSE '2001-01-01' END AS death_date FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def t11_u6_r2_deceased_merge(spark, d):
    """Old: every third; new: every second, and one from before 1900 that doesn't count."""
    cust = table(spark, d, "customer")
    of = lambda n, day: cust.where(f"c_custkey % {n} = 0").select(F.lower("c_name").alias("name_lower"), F.lit(day).alias("death_date"))
    return sinks.merge_deceased(of(3, "2001-01-01"), of(2, "2002-01-01").union(cust.limit(1).select(F.lit("old one"), F.lit("1899-12-31"))))


@query("SELECT c_custkey, 'pending' AS status FROM customer WHERE c_custkey % 5 BETWEEN 1 AND 3")
def t13_valid_claims(spark, d):
    k = F.col("c_custkey") % 5
    rows = table(spark, d, "customer").select("c_custkey", F.when(k == 0, "x").otherwise(F.col("c_name")).alias("subject"), F.when(k == 4, F.repeat(F.lit("p"), 51)).otherwise("knows").alias("predicate"), F.lit("someone").alias("object"), F.lit("paper").alias("source_name"), F.lit("5 let").alias("snippet"))
    return V.valid_claims(rows).select("c_custkey", "status")


@query(f"WITH {REL} SELECT source_name AS node, target_name AS alias FROM rel WHERE relation_type = 'ALIAS' UNION SELECT target_name, source_name FROM rel WHERE relation_type = 'ALIAS'")
def j12_alias_pairs(spark, d):
    return R.alias_pairs(rel(spark, d))


@query("WITH f AS (SELECT DISTINCT c_nationkey AS q, lower(c_mktsegment) AS fact FROM customer), g AS (SELECT s_name AS name, s_nationkey AS q, 1 AS seq FROM supplier UNION ALL SELECT s_name, (s_nationkey + 1) % 25, 2 FROM supplier), h AS (SELECT name, g.q, seq, count(*)::INT AS score FROM g JOIN f ON f.q = g.q JOIN (SELECT DISTINCT s_name, lower(c_mktsegment) AS near FROM supplier JOIN customer ON c_custkey % 100 = s_suppkey % 100) n ON n.s_name = name AND n.near = f.fact GROUP BY ALL) SELECT name, 'Q' || arg_min(q, seq - score * 10) AS qid, max(score)::INT AS score FROM h GROUP BY 1")
def j7_w2_u4_candidates(spark, d):
    supp, cust = table(spark, d, "supplier"), table(spark, d, "customer")
    q = lambda c: F.concat(F.lit("Q"), c)
    cand = supp.select(F.col("s_name").alias("name"), q(F.col("s_nationkey")).alias("qid"), F.lit(1).alias("seq")).union(supp.select("s_name", q((F.col("s_nationkey") + 1) % 25), F.lit(2)))
    near = supp.join(cust, F.col("c_custkey") % 100 == F.col("s_suppkey") % 100).select(F.col("s_name").alias("name"), F.col("c_mktsegment").alias("neighbour")).distinct()
    return P.verify_candidates(cand, cust.select(q(F.col("c_nationkey")).alias("qid"), F.col("c_mktsegment").alias("fact")), near).select("name", "qid", "score")


@query("SELECT 'grant ' || p_brand AS grantee, min(p_partkey) AS ein FROM part GROUP BY 1")
def j17_grantee_registry(spark, d):
    part = table(spark, d, "part")
    return V.match_grantees(part.select(F.concat(F.lit("grant "), "p_brand").alias("grantee")).distinct(), part.select(F.concat(F.lit(" GRANT "), "p_brand").alias("name"), F.col("p_partkey").alias("ein"), F.col("p_partkey").alias("seq")))


@query("SELECT c_name AS name FROM customer WHERE c_custkey % 3 <> 0")
def r3_pending(spark, d):
    cust = table(spark, d, "customer")
    return ingest.pending(cust.select(F.col("c_name").alias("name")), cust.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name")))


@query(f"WITH {REL} SELECT source_name AS name FROM rel UNION SELECT target_name FROM rel")
def u1_distinct_names(spark, d):
    """Sources and targets, as the index of raw names has them."""
    r = rel(spark, d)
    return r.select(F.col("source_name").alias("name")).union(r.select("target_name")).distinct()


@query("WITH s AS (SELECT l_orderkey, s_name AS inventor FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT inventor AS canonical, count(*) AS appearances FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def a11_o3_t12_patent_report(spark, d):
    lookup = P.name_lookup(table(spark, d, "supplier").select(F.col("s_name").alias("node"), F.col("s_suppkey").alias("seq")))
    return sinks.report(P.patent_report(_patents(spark, d).drop("canonical"), lookup), 40)


@query("SELECT 'Person ' || s_suppkey AS source_name, r AS relation_type, CASE r WHEN 'EMPLOYER' THEN 'Acme ' || s_suppkey WHEN 'ALMA_MATER' THEN 'Yale Law' ELSE 'Bob Stone' END AS target_name FROM supplier, (VALUES ('EMPLOYER'), ('ALMA_MATER'), ('ASSOCIATE')) t(r)")
def s19_f8_biographies(spark, d):
    text = F.format_string("She joined Acme %d Corp. in 2001. She later joined ACME %d, and stayed. She graduated from Yale Law in 1990. She reported to CEO Bob Stone for years", "s_suppkey", "s_suppkey")
    return web.biography_relations(table(spark, d, "supplier").select(F.format_string("Person %d", "s_suppkey").alias("person_name"), text.alias("bio_text")))


@query("SELECT CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN ' Alias ' || c_custkey WHEN 2 THEN 'nobody ' || c_custkey ELSE c_name END AS query, CASE WHEN c_custkey % 4 <> 2 THEN lower(c_name) END AS node FROM customer")
def g8_resolve(spark, d):
    cust = table(spark, d, "customer")
    asked = cust.select(F.expr("CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN ' Alias ' || c_custkey WHEN 2 THEN 'nobody ' || c_custkey ELSE c_name END").alias("query"))
    return G.resolve(asked, cust.select(F.col("c_name").alias("canonical"), F.concat(F.lit("alias "), "c_custkey").alias("name")), cust.select(F.lower("c_name").alias("node")))


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'Ann Mid Bo' || c_custkey WHEN 1 THEN 'Bo' || c_custkey || ' Ann' ELSE 'ANN BO' || c_custkey END AS contact, 'Ann Bo' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' Junior' END AS name FROM customer")
def j16_contacts(spark, d):
    cust = table(spark, d, "customer")
    asked = cust.select(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Ann Mid Bo' || c_custkey WHEN 1 THEN 'Bo' || c_custkey || ' Ann' ELSE 'ANN BO' || c_custkey END").alias("contact")).union(cust.select(F.concat(F.lit("Zed Y"), "c_custkey")))
    return V.match_contacts(asked, cust.select(F.expr("'Ann Bo' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' Junior' END").alias("name")))


@query(f"WITH {REL} SELECT DISTINCT {categorize_sql('relation_type')} AS category, CASE {categorize_sql('relation_type')} {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in PROBABILITY.items())} ELSE {PROBABILITY['OTHER']}::DOUBLE END AS probability FROM rel")
def d17_category_info(spark, d):
    return category_info(rel(spark, d).select(categorize(F.col("relation_type")).alias("category")).distinct())


_SAFE = "len(t) > 0 AND (contains(name, '-') OR len(t) = 2 AND len(t[-1]) >= 8 OR len(t) >= 3 AND len(t[-1]) >= 7)"


@query(f"WITH n AS (SELECT p_partkey, {RAW} AS name FROM part), k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(name)), '\\b(jr|sr)\\.?', '\\1', 'g'), '[^a-z0-9'' -]', ' ', 'g'), '\\s+', ' ', 'g'), ' .,') AS norm FROM n), w AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: x <> '') AS t FROM k) SELECT p_partkey, norm, {_SAFE} AS safe, norm <> '' AND (len(t) >= 3 OR len(t) = 2 AND len(list_filter(t, lambda x: len(x) >= 8)) > 0) AS sure FROM w")
def f5_p13_inventor_names(spark, d):
    n = F.col("name")
    return raw_names(spark, d).select("p_partkey", N.inventor_norm(n).alias("norm"), N.safe_match(n, F.lit(1)).alias("safe"), N.high_confidence(n, F.lit(1), F.lit(0)).alias("sure"))

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.plans import queries
from kinweave.operators import edges, evidence, graph, pairs, paths, resolve, search


def rel(spark, rows):
    return spark.createDataFrame([(i, None, s, ts, None, t, tt, r, "T", None) for i, (s, ts, t, tt, r) in enumerate(rows)], schemas.RELATIONSHIP)


def scored(spark, links):
    return spark.createDataFrame([(min(a, b), max(a, b), p, ["FRIEND"]) for a, b, p in links], schemas.SCORED_EDGE)


def test_clean_and_score(spark):
    r = rel(spark, [("Ann Bo", "PERSON", "Acme Inc", "COMPANY", "CEO"), ("Acme Inc", "COMPANY", "ann bo", "PERSON", "SPOUSE"), ("Ann Bo", "PERSON", "Cy Du", "PERSON", "DIRECTOR"), ("A", None, "a", None, "FRIEND"), ("A", None, "A", None, "FRIEND"), ("A", None, "", None, "FRIEND"), ("A", None, "B", None, "OWNERSHIP"), ("A", None, "B", None, "ALIAS")])
    out = {(x.a, x.b): x for x in edges.scored_edges(r).collect()}
    assert set(out) == {("acme inc", "ann bo")} and out["acme inc", "ann bo"].cats == ["CO_EXECUTIVE", "FAMILY"]
    assert out["acme inc", "ann bo"].prob == pytest.approx(1 - 0.13 * 0.08)
    assert edges.first_writer(r.union(r)).count() == 8


def brute(links, s, t, k, hops):
    adj = {}
    for a, b, p in links:
        adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = -math.log(p) - math.log(0.37)
    out = []

    def go(path, cost):
        if path[-1] == t:
            out.append((cost, path))
        elif len(path) <= hops:
            for v, w in adj.get(path[-1], {}).items():
                if v not in path:
                    go([*path, v], cost + w)

    go([s], 0.0)
    return sorted(out, key=lambda x: (round(x[0], 9), x[1]))[:k]


def test_paths_match_enumeration(spark):
    rng = random.Random(4)
    for _ in range(2):
        links = [(f"n{a}", f"n{b}", rng.choice([0.2, 0.5, 0.9])) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.5]
        found = paths.find_paths(scored(spark, links), "n0", "n6", k=4, max_hops=4).orderBy("rank").collect()
        want = brute(links, "n0", "n6", 4, 4)
        assert [round(r.cost, 6) for r in found] == [round(c, 6) for c, _ in want]
        assert all(len(set(r.path)) == len(r.path) for r in found)


def test_path_queries_take_all_links(spark, monkeypatch):
    # a path of six links, none of them of a large order: no filter or lower bound of hops may drop it
    ends = queries._ENDS
    chain = [ends[0], "c1", "s1", "c2", "s2", "c3", ends[1]]
    rows = rel(spark, [(a, None, b, None, "FRIEND") for a, b in zip(chain, chain[1:])]).withColumn("quantity", F.lit(1))
    gone = spark.createDataFrame([("x", -1.0)], "c_name string, c_acctbal double")
    monkeypatch.setattr(queries, "rel", lambda *_: rows)
    monkeypatch.setattr(queries, "table", lambda *_: gone)
    links = [(r.a, r.b, r.prob) for r in queries.scored(spark, "").collect()]
    want = brute(links, *ends, 5, 6)
    assert len(want) == 1
    found = queries.queries()["g4_paths"](spark, "").collect()
    assert [(round(r.cost, 6), list(r.path)) for r in found] == [(round(c, 6), p) for c, p in want]
    described = queries.queries()["d16_described_paths"](spark, "").collect()
    assert [[x.node for x in r.path] for r in described] == [p for _, p in want]


def test_pagerank_mass_components_percentile(spark):
    g = scored(spark, [("a", "b", 0.9), ("b", "c", 0.5), ("d", "e", 0.5)])
    ranks = graph.pagerank(g, max_iter=40)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert {r.node: r.label for r in graph.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert sorted(r.sci for r in graph.percentile(ranks).collect()) == [1, 20, 40, 60, 80]


def test_pagerank_query_converges(spark, monkeypatch):
    star = [("hub", f"n{i}") for i in range(6)] + [("n0", "end")]
    monkeypatch.setattr(queries, "rel", lambda *_: rel(spark, [(a, None, b, None, "FRIEND") for a, b in star]))
    got = {r.node: r.rank for r in queries.queries()["g3_pagerank_converged"](spark, "").collect()}
    near = {x: {b if x == a else a for a, b in star if x in (a, b)} for x in got}
    want = dict.fromkeys(got, 1 / len(got))
    for _ in range(300):
        want = {x: 0.15 / len(got) + 0.85 * sum(want[y] / len(near[y]) for y in near[x]) for x in got}
    assert len(got) == 8 and got == pytest.approx(want, abs=1e-4)


def test_overlap_rules(spark):
    cases = [((2000, 2005, 2004, 2010), (2004, 2005)), ((None, None, 2000, 2001), None), ((2000, None, 2008, None), (2008, 2008)), ((1900, 1960, 1950, 1955), None), ((2000, 2001, 2002, 2003), None)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, a int, b int, c int, d int").orderBy("i")
    got = [r[0] and tuple(r[0]) for r in df.select(pairs.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [w for _, w in cases]


def test_search_tiers(spark):
    rows = [("Ann Bo", 10, []), ("Ann Bo Trust", 10**5, []), ("Cy Annson", 1, []), ("Xann", 1, []), ("Zed", 1, ["ann x"]), ("ANN BO", 3, [])]
    index = spark.createDataFrame(rows, "canonical string, degree long, aliases array<string>")
    assert [r.canonical for r in search.search(index, "Ann").collect()] == ["Ann Bo Trust", "ANN BO", "Cy Annson", "Xann", "Zed"]
    assert search.search(index, "a").count() == 0


def test_resolution_and_matching(spark):
    nodes = spark.createDataFrame([("Ann Maxwell",), ("Ann Maxwells",), ("Bob Stone",)], "node string")
    got = {r.node: r.canonical for r in resolve.canonical_map(nodes).collect()}
    assert got["Ann Maxwell"] == got["Ann Maxwells"] == "Ann Maxwells" and got["Bob Stone"] == "Bob Stone"
    names = spark.createDataFrame([("Ann Bo",), ("Ann Bo Cy",)], "name string")
    contacts = spark.createDataFrame([("ann bo",), ("BO ANN",), ("Zed Zed",)], "contact string")
    assert {tuple(r) for r in evidence.match_contacts(contacts, names).collect()} == {("ann bo", "Ann Bo"), ("BO ANN", "Ann Bo")}
    h = names.select(evidence.salted(F.col("name"), "s").alias("hash"))
    assert tuple(evidence.private_counts(names, h.union(h), "s").first()) == (2, 4)
    assert tuple(evidence.private_counts(names, h, "").first()) == (0, 0)


def test_paths_between_hubs_follow_few_links(spark, monkeypatch):
    # two hubs with 40 common neighbours, behind each a tree that no good path uses: the bound is known before the frontier grows
    links = [(h, f"m{i}", 0.9) for h in ("s", "t") for i in range(40)] + [(f"m{i}", f"x{i}{j}", 0.5) for i in range(40) for j in range(10)]
    seen = []
    monkeypatch.setattr(paths, "written", lambda df: seen.append(df.count()) or graph.written(df))
    found = paths.find_paths(scored(spark, links), "s", "t", k=5).orderBy("rank").collect()
    assert [tuple(r.path) for r in found] == [("s", m, "t") for m in sorted(f"m{i}" for i in range(40))[:5]] and all(r.exact for r in found)
    assert seen[0] == len(links) and max(seen[1:]) <= 80


def test_bits_score_like_sets(spark):
    from kinweave.functions.categories import PROBABILITY
    from kinweave.functions.scoring import BITS, noisy_or, noisy_or_bits, used_bits, used_categories

    rng = random.Random(5)
    rows = [rng.sample(sorted(PROBABILITY), rng.randint(1, 9)) for _ in range(200)] + [[c, "SAME_ENTITY"] for c in PROBABILITY]
    df = spark.createDataFrame([(c, sum(BITS[x] for x in c)) for c in rows], "cats array<string>, bits long")
    assert df.where(~noisy_or(F.col("cats")).eqNullSafe(noisy_or_bits(F.col("bits"))) | (used_categories(F.col("cats")) != used_bits(F.col("bits")))).count() == 0


def test_overlap_totals_are_those_of_the_pairs(spark, monkeypatch):
    rng = random.Random(6)
    year = lambda: rng.choice([None, *range(2000, 2012)])
    rows = [(f"p{i}", rng.choice(["P108", "P69"]), rng.choice(["o1", "o2", None]), "", year(), year()) for i in range(80)] + [("old", "P69", "o1", "", 1900, 1990)]
    aff = spark.createDataFrame(rows, "person string, prop string, org string, org_label string, start_year int, end_year int").withColumn("org_label", F.col("org"))
    want = pairs.overlap_edges(aff).groupBy("rel").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends")).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, pairs.overlap_totals(aff).collect())) and len(want) == 2
    monkeypatch.setattr(queries, "_affiliations", lambda *_: aff)
    plan = queries.queries()["j4_f18_overlap"](spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_co_mentions_are_counted_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 40)
    monkeypatch.setattr(pairs, "STEP", 50)
    rng = random.Random(7)
    rows = [(f"r{rng.randint(0, 12)}", rng.choice(["ann", "ANN", "Bo", *(f"p{i}" for i in range(30))])) for _ in range(300)] + [(None, "ann"), ("r0", " ")]
    df = spark.createDataFrame(rows, "article string, person string")
    found = pairs.co_mentions(df, spark.createDataFrame([("ann",), ("bo",), *((f"p{i}",) for i in range(25))], "name string"))
    seen = {(r, p) for r, p in rows if r and (p.lower() in ("ann", "bo") or p[0] == "p" and int(p[1:]) < 25)}
    want = {}
    for r, a in seen:
        for s, b in seen:
            if r == s and a.lower() < b.lower():
                want[a, b] = want.get((a, b), 0) + 1
    assert sorted(map(tuple, found.collect())) == sorted((a, b, n) for (a, b), n in want.items())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

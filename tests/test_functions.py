import itertools

import pytest
from pyspark.sql import functions as F

from kinweave.functions import names as N, roles, scoring
from kinweave.functions.categories import CO_EMPLOYMENT, PROBABILITY, categorize


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_categorize_order(spark):
    want = {
        "TEN_PERCENT_OWNER": "CO_EXECUTIVE", "ROMANTIC_PARTNER": "CO_EXECUTIVE", "PRESS_SECRETARY": "CO_EXECUTIVE", "COOPERATED_WITH": "CO_EXECUTIVE", "ACTOR": "CO_EXECUTIVE", "DIRECTOR_D": "CO_DIRECTOR",
        "DIRECTOR (CFO)": "CO_DIRECTOR", "OFFICER_D": "CO_OFFICER", "CHIEF_OF_STAFF": "STAFF_AIDE", "AWARD_NOMINEE": "PUBLIC_OFFICE", "ASSOCIATE": "EMPLOYMENT", "INTERNATIONAL_TIE": "STAFF_AIDE", " spouse ": "FAMILY",
        "ALIAS": "SAME_ENTITY", None: "OTHER", "X": "OTHER", "SENIOR_FELLOW": "MEMBERSHIP", "LP_COMMITMENT": "FINANCIAL",
    }
    assert column(spark, list(want), categorize) == list(want.values())


def test_noisy_or_is_bounded_and_monotone(spark):
    cats = ["FAMILY", "CO_OFFICER", "CO_DIRECTOR", "DONATION", "SAME_ENTITY"]
    sets = [list(c) for k in range(6) for c in itertools.combinations(cats, k)]
    df = spark.createDataFrame([(s,) for s in sets], "c array<string>").select("c", scoring.noisy_or(F.col("c")).alias("p"), scoring.used_categories(F.col("c")).alias("u"))
    seen = {frozenset(r.c): r for r in df.collect()}
    for s, r in seen.items():
        rest = [c for c in s if c not in CO_EMPLOYMENT and c != "SAME_ENTITY"]
        own = [c for c in s if c in CO_EMPLOYMENT]
        if not rest and not own:
            assert r.p is None and r.u == []
            continue
        miss = 1.0
        for c in rest:
            miss *= 1 - PROBABILITY[c]
        if own:
            miss *= 1 - max(PROBABILITY[c] for c in own)
        assert r.p == pytest.approx(1 - miss) and 0 <= r.p <= 1
        for c in cats:
            if c not in s and (more := seen[s | {c}]).p is not None:
                assert more.p >= r.p - 1e-12


def test_names(spark):
    assert column(spark, ["Acme Co., Ltd.", "  Acme   Works ,; ", None, "Inc", "Acme L.L.C."], N.clean_name) == ["Acme", "Acme Works", "", "Inc", "Acme"]
    assert column(spark, ["Dr. Ann (CEO) Bo", "The Acme Group Inc", "The Of", "mr dr ann"], N.normalize_name) == ["dr. ann bo", "acme", "the of", "ann"]
    assert column(spark, ["O'BRIEN ANN MAY", "Ann Bo", "X ANN"], N.flip_filing_name) == ["Ann May O'Brien", "Ann Bo", "X ANN"]
    assert column(spark, ["Ann Bo", "Ann", "Acme Bank Bo", "Ann B0 Co"], N.looks_like_person) == [True, False, False, False]
    assert column(spark, ["Ann B", "Ann Lee", "Ann Bq", "Al", ""], N.is_fragment) == [True, False, True, True, True]
    assert column(spark, ["555-1234", "ann Bo", "Foo Center and Bar", "Ann and Bo", "Fund", "Ann, Bo", "Ann Bo"], N.is_obviously_bad) == [True, True, False, True, True, True, False]
    assert column(spark, ["Acme Trust", "The Club", "Ann House", "555-123-4567", "", "Ann Bo"], N.classify_basic) == ["org", "org", "location", "location", "unknown", "person"]
    assert column(spark, ["Acme Corp", "Foo institute Bar", "Ann Bo", "ann bo", "X"], N.classify_index) == ["company", "organization", "person", "entity", "person"]
    pairs = [("Ann Maxwell", "Anne Maxwells", True), ("Ann Maxwell", "Ann Maywell", True), ("Ann Lee", "Ann Leeds", False), ("Bob Maxwell", "Ann Maxwell", False), ("Ann", "Ann Bo", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in df.select(N.fuzzy_last_name(F.col("a"), F.col("b"))).collect()] == [w for *_, w in pairs]


def test_roles(spark):
    assert column(spark, ["Vice President", "President", "GP", "Owner", "Clerk"], roles.adv_relation) == ["EXECUTIVE_OFFICER", "CEO", "GENERAL_PARTNER", "CONTROL_PERSON", "OTHER_CONTROL"]
    assert column(spark, ["$150 million", "(8.69)", "-", "1,234"], lambda c: roles.amount(c).cast("double")) == [150e6, -8.69, None, 1234.0]
    assert column(spark, ["1998-01-02", "n/a", None], roles.year) == [1998, None, None]
    assert column(spark, ["Director", "Odd role"], lambda c: roles.form_d_relation(c, F.lit("X"))) == ["DIRECTOR_D", "ODD ROLE_D"]
    assert column(spark, ["320193", "x"], roles.pad_cik) == ["0000320193", None]

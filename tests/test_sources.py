import json

from kinweave import schemas
from kinweave.sources import files, filings, sinks, web
from kinweave.streaming.ingest import stream_edges


def payload(spark, *texts):
    return spark.createDataFrame([("1", t) for t in texts], "cik string, payload string")


def test_submissions(spark):
    good = json.dumps({"name": "A", "formerNames": [{"name": "B"}], "filings": {"recent": {"form": ["4", "D", "4"], "accessionNumber": ["1-2", "3-4"], "filingDate": ["2001-01-01"], "primaryDocument": ["x/y.xml"]}}})
    rows = filings.submissions(payload(spark, good, "{bad")).orderBy("nth").collect()
    assert [(r.nth, r.accession, r.document) for r in rows] == [(0, "12", "y.xml"), (2, None, None)]
    assert filings.former_names(payload(spark, good)).first().target_name == "B"


def test_ownership_and_offering_forms(spark):
    f4 = "junk<XML><?xml version='1.0'?><ownershipDocument><issuer><issuerCik>1</issuerCik><issuerName>Acme</issuerName></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>2</rptOwnerCik><rptOwnerName>Bo Ann</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>0</isDirector><isOfficer>true</isOfficer><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner></ownershipDocument></XML>"
    assert [(r.issuer, r.owner, r.relation) for r in filings.form4(payload(spark, f4, f4.replace("Acme", "A & B"), f4.replace("Acme", "<b><i>x</b></i>"), "<x>", None)).collect()] == [("Acme", "Bo Ann", "OFFICER (CFO)")]
    person = "<relatedPersonInfo><relatedPersonName><firstName>Ann</firstName><lastName>Bo</lastName></relatedPersonName><relatedPersonRelationshipList><relationship>Director</relationship></relatedPersonRelationshipList><relationshipDetails><isPromoter>1</isPromoter></relationshipDetails></relatedPersonInfo>"
    fd = f"<edgarSubmission><primaryIssuer><entityName>Acme</entityName><cik>9</cik></primaryIssuer><relatedPersonsList>{person}</relatedPersonsList></edgarSubmission>"
    assert {(r.person, r.relation) for r in filings.form_d(payload(spark, fd)).collect()} == {("Ann Bo", "DIRECTOR_D"), ("Ann Bo", "PROMOTER_D")}


def test_nonprofit_forms(spark):
    x = "<Return xmlns='u'><Filer><BusinessName><BusinessNameLine1Txt>Good</BusinessNameLine1Txt></BusinessName></Filer><G><PersonNm>Ann</PersonNm><TitleTxt>Chair</TitleTxt><ReportableCompFromOrgAmt>5</ReportableCompFromOrgAmt></G><G><PersonNm>ANN</PersonNm><TitleTxt>CHAIR</TitleTxt></G></Return>"
    assert [tuple(r) for r in filings.nonprofit_officers(payload(spark, x, "<bad")).collect()] == [("Good", "Ann", "Chair", 5.0)]


def test_web(spark):
    js = json.dumps({"results": {"bindings": [{"person": {"value": "http://x/Q1"}, "prop": {"value": "http://x/P108"}, "org": {"value": "http://x/Q2"}, "orgLabel": {"value": "Acme"}, "start": {"value": "1999-01-01"}}]}})
    r = web.affiliations(payload(spark, js)).first()
    assert (r.person, r.prop, r.start_year, r.end_year) == ("Q1", "P108", 1999, None)
    bio = spark.createDataFrame([("Ann Bo", "She joined Acme Inc. in 1999. She served under Cy Dumont. She attended Upper College, and left.")], "person_name string, bio_text string")
    assert {(x.relation_type, x.target_name) for x in web.biography_relations(bio).collect()} >= {("EMPLOYER", "Acme"), ("ASSOCIATE", "Cy Dumont"), ("ALMA_MATER", "Upper College")}
    html = spark.createDataFrame([("F", "<tr><th>Key people</th><td>Ann Bo, LLC x; Cy D.</td></tr>")], "firm string, html string")
    assert {x.partner for x in web.partners(html).collect()} == {"Ann Bo"}
    wiki = spark.createDataFrame([("A", "{{Infobox officeholder\n| office = [[Mayor of X|Mayor]]\n| alma_mater = [[Upper College]]\n}}")], "name string, text string")
    assert {(x.kind, x.value) for x in web.infobox(wiki).collect()} == {("title", "Mayor"), ("education", "Upper College")}


def test_graph_and_evidence_files(spark):
    g = json.dumps({"nodes": ["b", "a"], "edges": [[0, 1, 0.5, ["FRIEND"]]]})
    assert tuple(files.scored_graph(payload(spark, g)).first()) == ("a", "b", 0.5, ["FRIEND"])
    e = json.dumps({"a|b|CEO": [{"source": "s", "snippet": "t"}]})
    assert files.evidence_index(payload(spark, e)).first().rel == "CEO"


def test_commitments_and_contacts(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Pension Fund,FundName,CommitmentAmount,VintageYear\nP,F,\"1,000\",x\n,G,1,1\n")
    assert [tuple(r) for r in files.pension_commitments(spark, str(tmp_path / "c.csv")).collect()] == [("P", "F", 0, 0, "Venture Capital")]  # a number with a comma is no whole number
    (tmp_path / "v.vcf").write_text("FN:Ann Bo\nN:Du;Cy\nEMAIL:a,b\nEve,Fox\nTEL:1\n")
    assert {r.contact for r in files.contacts(spark, str(tmp_path / "v.vcf")).collect()} == {"Ann Bo", "Cy Du", "Eve Fox"}


def test_sinks_and_stream(spark, tmp_path):
    row = {"ingest_seq": 1, "source_name": "A", "target_name": "B", "relation_type": "R", "source_data": "T"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(row | {"ingest_seq": i}) for i in range(3)))
    for i in range(2):
        stream_edges(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"cp{i}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    rel = spark.createDataFrame([row | {"evidence": None}], schemas.RELATIONSHIP)
    sinks.replace_source(rel, str(tmp_path / "parts"))
    sinks.replace_source(rel, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 1
    old = spark.createDataFrame([("a", "1950-01-01")], schemas.DECEASED)
    new = spark.createDataFrame([("b", "1960-01-01"), ("c", "1850-01-01")], schemas.DECEASED)
    assert sinks.merge_deceased(old, new).count() == 2

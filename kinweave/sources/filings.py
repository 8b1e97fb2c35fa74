"""Filings: submission lists, ownership, offering, nonprofit and adviser forms. Payload tables hold one document a row."""
from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import title_case  # noqa: F401  (re-exported for callers that show names)
from ..functions.roles import accession, adv_relation, basename, form4_relation, form_d_relation, pad_cik

_SUBMISSION = "name string, formerNames array<struct<name:string>>, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,primaryDocument:array<string>>>"


def submissions(payloads: DataFrame, forms: tuple[str, ...] = ("4",)) -> DataFrame:
    """(cik, form, accession, filing_date, document, nth) of payloads (cik, payload); parallel arrays of unequal length are padded with nulls, bad JSON gives none."""
    p = F.from_json("payload", _SUBMISSION)
    rows = payloads.select(pad_cik(F.col("cik")).alias("cik"), p.getField("filings").getField("recent").alias("r"))
    rows = rows.select("cik", F.posexplode(F.arrays_zip("r.form", "r.accessionNumber", "r.filingDate", "r.primaryDocument")).alias("nth", "x"))
    x = F.col("x")
    return rows.where(x["form"].isin(*forms)).select("cik", x["form"].alias("form"), accession(x["accessionNumber"]).alias("accession"), x["filingDate"].alias("filing_date"), basename(x["primaryDocument"]).alias("document"), "nth")


def form_histogram(payloads: DataFrame) -> DataFrame:
    """(cik, form, n) over all recent filings."""
    p = F.from_json("payload", _SUBMISSION)
    return payloads.select("cik", F.explode(p["filings"]["recent"]["form"]).alias("form")).groupBy("cik", "form").agg(F.count("*").alias("n"))


def former_names(payloads: DataFrame) -> DataFrame:
    p = F.from_json("payload", _SUBMISSION)
    return payloads.select(p["name"].alias("source_name"), F.explode(p["formerNames"]).alias("f")).select("source_name", F.col("f.name").alias("target_name"), F.lit("FORMER_NAME").alias("relation_type"))


def company_ciks(payloads: DataFrame) -> DataFrame:
    """(cik) of company lists: a map of any key to {cik_str}."""
    rows = payloads.select(F.explode(F.map_values(F.from_json("payload", "map<string,struct<cik_str:string,title:string>>"))).alias("c"))
    return rows.select(F.lpad(F.col("c.cik_str"), 10, "0").alias("cik"), F.col("c.title").alias("title"))


def _plain_xml(text: Column) -> Column:
    """The document between <XML> tags if there are any, without declaration and namespaces."""
    inner = F.regexp_extract(text, r"(?is)<XML>(.*?)</XML>", 1)
    x = F.when(inner != "", inner).otherwise(text)
    x = F.regexp_replace(x, r"<\?xml[^>]*\?>", "")
    x = F.regexp_replace(x, r"(</?)[A-Za-z0-9_]+:", "$1")
    return F.concat(F.lit("<root>"), F.regexp_replace(x, r"\sxmlns(:\w+)?=\"[^\"]*\"|\s[A-Za-z0-9_]+:(?=[A-Za-z0-9_]+=)", " "), F.lit("</root>"))


def _parsed(text: Column, schema: str) -> Column:
    """XML by a schema; all null where it can't be parsed, as one bad filing mustn't end the job."""
    return F.from_xml(text, schema, {"rowTag": "root", "mode": "PERMISSIVE"})


def form4(payloads: DataFrame) -> DataFrame:
    """(issuer_cik, issuer, owner_cik, owner, is_director, is_officer, is_ten_percent, title, relation) of payloads (payload): the first owner of each; malformed filings, incomplete issuers
    and nameless owners give none."""
    owner = "struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>"
    x = _parsed(_plain_xml(F.col("payload")), f"ownershipDocument struct<issuer:struct<issuerCik:string,issuerName:string>,reportingOwner:array<{owner}>>")["ownershipDocument"]
    rows = payloads.select(x.alias("x")).select("x.issuer", F.try_element_at("x.reportingOwner", F.lit(1)).alias("o"))
    at = lambda c: F.coalesce(F.trim(c), F.lit(""))
    flag = lambda c: F.lower(at(f"o.reportingOwnerRelationship.{c}")).isin("1", "true").alias
    out = rows.select(at("issuer.issuerCik").alias("issuer_cik"), at("issuer.issuerName").alias("issuer"), at("o.reportingOwnerId.rptOwnerCik").alias("owner_cik"), at("o.reportingOwnerId.rptOwnerName").alias("owner"), flag("isDirector")("is_director"), flag("isOfficer")("is_officer"), flag("isTenPercentOwner")("is_ten_percent"), at("o.reportingOwnerRelationship.officerTitle").alias("title"))
    out = out.where("issuer_cik <> '' AND issuer <> '' AND owner <> ''")
    return out.withColumn("relation", form4_relation(F.col("is_director"), F.col("is_officer"), F.col("is_ten_percent"), F.col("title")))


def form_d(payloads: DataFrame, source_data: str = "SEC_D") -> DataFrame:
    """(issuer, issuer_cik, person, role, relation): a row for each role of each related person."""
    x = payloads.select(_plain_xml(F.col("payload")).alias("x"))
    person = "struct<relatedPersonName:struct<firstName:string,lastName:string>,relatedPersonRelationshipList:struct<relationship:array<string>>,relationshipDetails:struct<isDirector:string,isExecutiveOfficer:string,isPromoter:string>>"
    parsed = _parsed(F.col("x"), f"edgarSubmission struct<primaryIssuer:struct<entityName:string,cik:string>,relatedPersonsList:struct<relatedPersonInfo:array<{person}>>>")
    rows = x.select(parsed["edgarSubmission"].alias("d")).select(F.trim("d.primaryIssuer.entityName").alias("issuer"), pad_cik(F.col("d.primaryIssuer.cik")).alias("issuer_cik"), F.explode("d.relatedPersonsList.relatedPersonInfo").alias("p"))
    true = lambda n: F.when(F.lower(F.trim(F.col(f"p.relationshipDetails.{n}"))).isin("1", "true"), F.lit(n))
    roles = F.concat(F.coalesce(F.col("p.relatedPersonRelationshipList.relationship"), F.array().cast("array<string>")), F.array_compact(F.array(*map(true, ("isDirector", "isExecutiveOfficer", "isPromoter")))))
    name = F.trim(F.concat_ws(" ", F.trim("p.relatedPersonName.firstName"), F.trim("p.relatedPersonName.lastName")))
    return rows.select("issuer", "issuer_cik", name.alias("person"), F.explode(roles).alias("role")).where("issuer <> '' AND person <> ''").withColumn("relation", form_d_relation(F.trim("role"), F.lit(source_data)))


def nonprofit_officers(payloads: DataFrame) -> DataFrame:
    """(filer, name, title, compensation): any element with a name and a title child; the first of each upper-cased (name, title)."""
    fields = "filer string, name string, title string, compensation double"

    def parse(batches):
        for pdf in batches:
            rows = []
            for text in pdf["payload"]:
                try:
                    root = ET.fromstring(re.sub(r"^[^<]*", "", text or ""))
                except ET.ParseError:
                    continue
                rows += officers_of(root)
            yield pd.DataFrame(rows, columns=["filer", "name", "title", "compensation"])

    return payloads.select("payload").mapInPandas(parse, fields)


def officers_of(root: ET.Element) -> list[tuple[str, str, str, float]]:
    tag = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: (e.text or "").strip()
    filer, out, seen = "", [], set()
    for wanted in ("BusinessNameLine1Txt", "BusinessNameLine1", "BusinessName"):
        filer = filer or next((text(e) for e in root.iter() if tag(e) == wanted and text(e)), "")
    for group in root.iter():
        own = {tag(c): text(c) for c in group}
        name = own.get("PersonNm") or own.get("PersonName") or own.get("NamePerson")
        title = own.get("PersonTitleTxt") or own.get("TitleTxt") or own.get("Title")
        if not name or not title or (key := (name.upper(), title.upper())) in seen:
            continue
        seen.add(key)
        pay = 0.0
        for k, v in own.items():
            if "ompensation" in k or "Comp" in k:
                try:
                    pay = float(v)
                    break
                except ValueError:
                    pass
        out.append((filer, name, title, pay))
    return out


def grantees(payloads: DataFrame) -> DataFrame:
    """(grantee): distinct names in the grants of nonprofit returns; malformed ones give none."""
    def parse(batches):
        for pdf in batches:
            out = []
            for text in pdf["payload"]:
                try:
                    root = ET.fromstring(re.sub(r"^[^<]*", "", text or ""))
                except ET.ParseError:
                    continue
                groups = (g for g in root.iter() if g.tag.rpartition("}")[2] == "GrantOrContributionPdDurYrGrp")
                out += [e.text for g in groups for e in g.iter() if e.tag.rpartition("}")[2] == "BusinessNameLine1Txt" and e.text]
            yield pd.DataFrame({"grantee": out}, dtype="str")

    return payloads.select("payload").mapInPandas(parse, "grantee string").select(F.trim("grantee").alias("grantee")).where("grantee <> ''").distinct()


def adviser_owners(payloads: DataFrame) -> DataFrame:
    """(firm, owner, title, relation) of ownership schedules in XML; malformed ones give none."""
    first = lambda *c: F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in c))
    x = _parsed(_plain_xml(F.col("payload")), "FirmName string, LegalName string, BusinessName string, ScheduleA struct<Owner:array<struct<Name:string,IndividualName:string,FullName:string,Title:string,CRD:string>>>")
    rows = payloads.select(x.alias("x")).select(F.coalesce(first(F.col("x.FirmName"), F.col("x.LegalName"), F.col("x.BusinessName")), F.lit("Unknown VC Firm")).alias("firm"), F.explode("x.ScheduleA.Owner").alias("o"))
    return rows.select("firm", first(F.col("o.Name"), F.col("o.IndividualName"), F.col("o.FullName")).alias("owner"), F.trim(F.coalesce("o.Title", F.lit(""))).alias("title")).where("owner IS NOT NULL").withColumn("relation", adv_relation(F.col("title")))


def adviser_firm_owners(payloads: DataFrame) -> DataFrame:
    """(firm, owner, title, relation) of adviser JSON: all owner lists together."""
    one = "array<struct<name:string,fullName:string,title:string,position:string,crd:string>>"
    lists = ("direct_owners", "indirect_owners", "owners", "directOwners", "indirectOwners", "control_persons")
    p = F.from_json("payload", "legal_name string, firm_name string, name string, " + ", ".join(f"{c} {one}" for c in lists))
    none = F.lit(None).cast(one)
    rows = payloads.select(F.coalesce(p["legal_name"], p["firm_name"], p["name"], F.lit("Unknown VC Firm")).alias("firm"), F.explode(F.concat(*(F.coalesce(p[c], F.coalesce(none, F.array().cast(one))) for c in lists))).alias("o"))
    return rows.select("firm", F.coalesce("o.name", "o.fullName").alias("owner"), F.coalesce("o.title", "o.position", F.lit("")).alias("title")).where("trim(owner) <> ''").withColumn("relation", adv_relation(F.col("title")))

"""Relations and types from titles, roles and property names."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Maps and ordered rules of the sources.
FORM_D_ROLES = {"Director": "DIRECTOR", "Executive Officer": "OFFICER", "Promoter": "PROMOTER", "isDirector": "DIRECTOR", "isExecutiveOfficer": "OFFICER", "isPromoter": "PROMOTER"}
TITLE_RULES = [
    ("GENERAL_PARTNER", "general partner|gp|managing partner"), ("MANAGING_DIRECTOR", "managing director|md"), ("EXECUTIVE_OFFICER", "vice president|vp"), ("MANAGING_DIRECTOR", "partner"), ("CEO", "ceo|chief executive|president"),
    ("CFO", "cfo|chief financial"), ("COO", "coo|chief operating"), ("EXECUTIVE_OFFICER", "executive|officer"), ("DIRECTOR", "director|board"), ("CONTROL_PERSON", "owner|member|principal"),
]
DOCUMENT_RELATIONS = {"EMPLOYED": "EMPLOYED_BY", "REPRESENTED": "REPRESENTED_BY", "COMMUNICATED": "COMMUNICATED_WITH", "MET": "MET_WITH", "PAID": "PAID_BY", "ASSOCIATED": "ASSOCIATED_WITH"}
DOCUMENT_TYPES = {"Person": "PERSON", "Organization": "ORGANIZATION", "Location": "LOCATION", "Unknown": "UNKNOWN"}
PROPERTY_RULES = [("P112", "FOUNDER"), ("P169", "CEO"), ("P3320", "CO_DIRECTOR"), ("P1037", "CO_EXECUTIVE"), ("P26", "FAMILY")]
CLAIM_ROLES = {"P39": "HELD", "P108": "EMPLOYED_BY", "P69": "EDUCATED_AT", "P1416": "AFFILIATED_WITH", "P512": "ACADEMIC_DEGREE", "P802": "STUDENT"}
CLAIM_TYPES = {"P39": "POSITION", "P108": "ORGANIZATION", "P1416": "ORGANIZATION", "P69": "INSTITUTION", "P512": "INSTITUTION"}


def mapped(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return found if default is None else F.coalesce(found, default)


def form4_relation(director: Column, officer: Column, ten_percent: Column, title: Column) -> Column:
    has = F.coalesce(title, F.lit("")) != ""
    rel = F.when(director, "DIRECTOR").when(officer, "OFFICER").when(ten_percent, "TEN_PERCENT_OWNER").when(has, "OFFICER").otherwise("INSIDER")
    return F.when(has, F.concat(rel, F.lit(" ("), title, F.lit(")"))).otherwise(rel)


def form_d_relation(role: Column, source_data: Column) -> Column:
    suffix = F.when(source_data == "SEC_FORM_D", "").otherwise("_D")
    return F.concat(mapped(role, FORM_D_ROLES, F.upper(role)), suffix)


def adv_relation(title: Column) -> Column:
    t, out = F.trim(F.lower(title)), None
    for relation, words in TITLE_RULES:
        out = F.when(t.rlike(words), relation) if out is None else out.when(t.rlike(words), relation)
    return out.otherwise("OTHER_CONTROL")


def document_relation(kind: Column) -> Column:
    return mapped(kind, DOCUMENT_RELATIONS, kind)


def document_type(kind: Column) -> Column:
    return mapped(kind, DOCUMENT_TYPES, F.lit("UNKNOWN"))


def property_relation(uri: Column) -> Column:
    out = None
    for prop, relation in PROPERTY_RULES:
        out = F.when(uri.contains(prop), relation) if out is None else out.when(uri.contains(prop), relation)
    return out.otherwise("ASSOCIATE")


def claim_role(uri: Column) -> Column:
    return mapped(F.substring_index(uri, "/", -1), CLAIM_ROLES, F.lit("AFFILIATED"))


def claim_type(uri: Column) -> Column:
    return mapped(F.substring_index(uri, "/", -1), CLAIM_TYPES, F.lit("RELATED"))


def fund_type(asset_class: Column) -> Column:
    return F.when(F.lower(F.coalesce(asset_class, F.lit(""))).rlike("buyout|growth|private equity"), "FINANCIAL_FIRM").otherwise("VC_FIRM")


def fund_type_exact(asset_class: Column, financial: list[str]) -> Column:
    """By whole asset classes, as seed lists use it."""
    return F.when(asset_class.isin(financial), "FINANCIAL_FIRM").otherwise("VC_FIRM")


def pad_cik(cik: Column) -> Column:
    return F.when(F.trim(cik).rlike("^[0-9]{1,10}$"), F.lpad(F.trim(cik), 10, "0"))


def ein(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) == 9, digits)


def accession(value: Column) -> Column:
    return F.replace(value, F.lit("-"), F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def year(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}"), F.substring(text, 1, 4).cast("int"))


def amount(text: Column) -> Column:
    """Accounting text as a decimal: "$1,234.50", "(8.69)" is negative, "$150 million" is scaled, "-" is null."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(F.regexp_replace(t, "[$,]", ""), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("decimal(20,2)")
    scale = F.when(t.contains("billion"), 1_000_000_000).when(t.contains("million"), 1_000_000).otherwise(1)
    return (n * scale * F.when(t.rlike(r"^\(.*\)$|^-[0-9$]"), -1).otherwise(1)).cast("decimal(20,2)")


def compensation(text: Column, fallback: Column | None = None) -> Column:
    own = text.try_cast("double")
    return F.coalesce(own, *(() if fallback is None else (fallback.try_cast("double"),)), F.lit(0.0))

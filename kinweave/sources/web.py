"""Query results, wiki text, pages and biographies."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.roles import claim_role, claim_type, property_relation, year


def bindings(payloads: DataFrame, *names: str) -> DataFrame:
    """One column of text for each variable of SPARQL result JSON."""
    b = F.from_json("payload", "results struct<bindings:array<map<string,struct<value:string>>>>")["results"]["bindings"]
    rows = payloads.select(F.explode(b).alias("b"))
    return rows.select(*(F.try_element_at("b", F.lit(n))["value"].alias(n) for n in names))


def tail(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def key_people(payloads: DataFrame, firm: str = "firmLabel") -> DataFrame:
    """(source_name, target_name, relation_type) of people by property."""
    rows = bindings(payloads, "personLabel", "prop", firm).where("personLabel IS NOT NULL")
    return rows.select(F.col("personLabel").alias("source_name"), F.col(firm).alias("target_name"), property_relation(F.col("prop")).alias("relation_type"))


def affiliations(payloads: DataFrame) -> DataFrame:
    """(person, prop, org, org_label, start_year, end_year)."""
    rows = bindings(payloads, "person", "prop", "org", "orgLabel", "start", "end")
    return rows.select(tail(F.col("person")).alias("person"), tail(F.col("prop")).alias("prop"), tail(F.col("org")).alias("org"), F.col("orgLabel").alias("org_label"), year(F.col("start")).alias("start_year"), year(F.col("end")).alias("end_year"))


def deaths(payloads: DataFrame) -> DataFrame:
    rows = bindings(payloads, "personLabel", "death").where("personLabel IS NOT NULL AND death IS NOT NULL")
    return rows.groupBy(F.lower("personLabel").alias("name_lower")).agg(F.min(F.substring("death", 1, 10)).alias("death_date"))


def claims(payloads: DataFrame) -> DataFrame:
    """(name, target_name, target_type, relation_type) of claims (name, payload) with a label of more than five letters."""
    b = F.from_json("payload", "results struct<bindings:array<map<string,struct<value:string>>>>")["results"]["bindings"]
    rows = payloads.select("name", F.explode(b).alias("b")).select("name", F.try_element_at("b", F.lit("prop"))["value"].alias("prop"), F.try_element_at("b", F.lit("valLabel"))["value"].alias("val"))
    return rows.where("length(val) > 5").select("name", F.col("val").alias("target_name"), claim_type(F.col("prop")).alias("target_type"), claim_role(F.col("prop")).alias("relation_type"))


#: Infobox kinds, in two goes, and the fields read.
_BOXES = ("officeholder|judge|office\\s+holder", "person|scientist|professor|military|politician")
_TITLES = ("president", "office", "title", "minister", "secretary", "judgeship")
_SCHOOLS = ("education", "alma_mater")


def infobox(pages: DataFrame) -> DataFrame:
    """(name, kind, value) of wiki text (name, text): titles as plain text under 200 letters, and schools that are links."""
    box = F.lit("")
    for kind in reversed(_BOXES):
        found = F.regexp_extract("text", rf"(?i)\{{\{{Infobox\s+(?:{kind})\s*([\s\S]*?\n\}})", 1)
        box = F.when(found != "", found).otherwise(box)
    field = lambda f: F.regexp_extract("box", rf"(?is)\|\s*{f}\s*=\s*(.+?)(?=\n\||\n\}})", 1)
    plain = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\[\[[^\]]*?\|([^\]]*)\]\]", "$1"), r"\[\[([^\]]*)\]\]", "$1"), r"\s+", " ")), "'{2,}", "")
    links = lambda c: F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    rows = pages.select("name", box.alias("box"))
    titles = rows.select("name", F.lit("title").alias("kind"), F.explode(F.array(*(plain(field(f)) for f in _TITLES))).alias("value"))
    schools = rows.select("name", F.lit("education").alias("kind"), F.explode(F.concat(*(links(field(f)) for f in _SCHOOLS))).alias("value"))
    return titles.union(schools).where("value <> '' AND length(value) < 200").distinct()


#: Table headings and words that begin no name.
_HEADINGS = ("Key people", "Founders", "Number of partners", "Notable partners", "Managing partners")
_SKIP = "cpa|llc|llp|inc\\.|ltd|chairman|managing partner|executive"


def partners(pages: DataFrame) -> DataFrame:
    """(firm, partner) of infobox rows of pages (firm, html)."""
    cells = F.concat(*(F.regexp_extract_all("html", F.lit(rf"(?is)<th[^>]*>(?:.*?){h}(?:.*?)</th>\s*<td[^>]*>(.*?)</td>"), F.lit(1)) for h in _HEADINGS))
    rows = pages.select("firm", F.explode(cells).alias("cell")).select("firm", F.explode(F.split(F.regexp_replace("cell", "<[^>]+>", " "), "[,;]")).alias("p"))
    rows = rows.select("firm", F.btrim(F.trim(F.regexp_replace("p", r"\s+", " ")), F.lit(".")).alias("partner"))
    return rows.where((F.length("partner") >= 4) & ~F.lower("partner").rlike(rf"^(?:{_SKIP})") & F.col("partner").rlike(r"^[A-Z][a-z]+ (?:[A-Z][a-z]+|[A-Z]\.)")).distinct()


# How biographies tell relations.
_ORG = r"([A-Z][A-Za-z0-9&'\s,\.-]+?)"
_PERSON = r"([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)"
_SOME = r"(?:[\w\s\-]{1,50})"
BIOGRAPHY = [
    ("EMPLOYER", rf"\b(?:joined|joining|at|with)\s+{_ORG}(?:\s+in\s+\d{{4}}|\s+since|\s+where|\.|\s+and|\s+as|\s+to|,)"),
    ("EMPLOYER", rf"\b(?:served as|has been|was|is)\s+{_SOME}\s+(?:of|at|for)\s+{_ORG}(?:\s+in\s+\d{{4}}|\s+since|\s+where|\.|\s+and|,)"),
    ("ALMA_MATER", rf"\b(?:graduated from|degree from|attended|MBA from|holds a {_SOME} from|received a {_SOME} from|earned a {_SOME} from)\s+{_ORG}(?:\s+in\s+\d{{4}}|\s+and|\s+where|\.|\s+with|,)"),
    ("ASSOCIATE", rf"\b(?:reported directly to|reported to)\s+(?:CEO|Chairman|President|executive VP)?\s*{_PERSON}"),
    ("ASSOCIATE", rf"\b(?:founded|co-founded)\s+(?:[\w\s\-']{{1,50}})\s+(?:with|alongside)\s+{_PERSON}"),
    ("ASSOCIATE", rf"\b(?:served under|working under)\s+{_PERSON}"),
]
_TURNS = r"(?i)\b(?:since|joined|joining|served|prior|where|reported|graduated|holds|received|earned|attended|degree|mba|bs|ba|phd|in|at|from|to|with|and)\b"
_ENDS = r"(?i)\s*,?\s*\b(?:Inc|Corp|Corporation|Ltd|Limited|LLC|L\.L\.C\.|Co|Company|Companies|SA|S\.A\.|AG|A\.G\.|PLC)\b\.?$"


def biography_relations(bios: DataFrame, person: str = "person_name", text: str = "bio_text") -> DataFrame:
    """(source_name, relation_type, target_name) of biographies; each relation and lower-cased target once."""
    def told(kind, pattern):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("relation_type"), x.alias("t")))

    found = F.concat(*(told(k, p) for k, p in BIOGRAPHY))
    rows = bios.where(F.col(person).isNotNull() & F.col(text).isNotNull()).select(F.col(person).alias("source_name"), F.posexplode(found).alias("i", "x")).select("source_name", "i", "x.*")
    t = F.trim(F.element_at(F.split(F.trim("t"), _TURNS), 1))
    t = F.when(F.col("relation_type") != "ASSOCIATE", F.regexp_replace(t, _ENDS, "")).otherwise(t)
    rows = rows.withColumn("target_name", F.btrim(t, F.lit(",. "))).where((F.length("target_name") > 2) & (F.lower("target_name") != F.lower("source_name")))
    return rows.groupBy("source_name", "relation_type", F.lower("target_name").alias("_k")).agg(F.min_by("target_name", "i").alias("target_name")).drop("_k")

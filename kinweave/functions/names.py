"""Name cleaning, normalising and classing, as Column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Words and patterns of the rules below.
_CORPORATE = r"(?:inc|incorporated|corp|corporation|ltd|limited|l\.?l\.?c\.?|co|company|l\.?p\.?|p\.?l\.?c\.?|s\.?a\.?|a\.?g\.?)"
_CLEAN = rf"(?iU)(?:[\s,]+{_CORPORATE}\.?|[\s,;:]+)+$"
ORG_WORDS = "Inc|Corp|LLC|Company|Co|Group|Foundation|University|College|Bank|Partners|Holdings|Trust|Fund|Capital|Ltd|Institute|Center|Centre|Committee|Council|Systems|Technologies|Services|Corporation|Enterprises|Industries|Management|Ventures|Associates|Media|Properties|Realty|Organization|Association|Society|School|Hospital|Church|Authority|Commission|Bureau|Agency|Department|National|International|Global|Network|Union|League|Academy|Museum|Library|Times|Post|Journal|News|Press|Labs|Laboratory|Office|Board"
ORG_WORDS_RESOLVER = "Inc|Corp|Company|Group|Foundation|University|College|Bank|Capital|Institute|Committee|Council|Trust|Fund|LLC|Ltd|Holdings|Partners|Associates|School|Systems|Corporation|PAC|Victory|For|Campaign|Securities|Management"
ORG_WORDS_PATENT = r"inc|corp|corporation|company|co\.?|group|foundation|university|college|bank|capital|institute|committee|council|trust|fund|llc|ltd|holdings|partners|associates|school|systems|management|technologies|technology|health|pharma|biotech|laboratories|lab|gmbh|ag|sa|bv|s\.r\.l\.|plc"
TITLES = "mr mrs ms dr president ceo cfo chief executive managing director attorney defendant".split()
SUFFIXES = "inc corp llc llp ltd co company foundation trust group holdings limited international".split()
NOISE = "the of & and".split()
EXTRACTION_NOISE = r"(?i)\s*-\s*(?:OAP|TAP|IHD|ARFI|DYS|HY)\s*\w*\s*$|\s+Ssn\s*$|\s+Inc\s+Air\s*$|\s+Mc\s+Air\s*$|\s+Air\s+\w+\s*$|\s+\(.*?\)\s*$"
SHORT_SURNAMES = "lee fox van von dee ray roe day key rey bey jae rae mey lay hay loe nau vos".split()
LOCATION_WORDS = "house residence mansion apartment home".split()
COMPANY_ENDS = "inc corp llc llp ltd co corporation incorporated company group holdings bank trust fund capital partners".split()
ORG_PARTS = "university college institute school foundation center".split()
NON_NAMES = "products services employees members officers investors campaign administration businesses transactions secret investigation conspiracy agreement contract documents officials representatives candidates application offerings securities placement agents advisor investigator reporter reporters journalist analyst specialist consultant assistant coordinator girl girls woman women child children minor victim victims accuser accusers associate associates card account accounts payment payments deposit airport airline flight hotel restaurant hospital university college school bank banks fund committee commission agency bureau department group team unit division office firm international national global regional local official platform platforms network system program project initiative plan policy regulation".split()
BAD_PHRASES = ["and ", " of ", " to ", " for ", " the ", " in ", " on ", " at ", "products and services", "services and products", "card ending in", "products and", "and services", "members of", "part of", "type of"]
STARTERS = "the a an this that these those all any each every some many for with without under over through".split()


def tokens(name: Column) -> Column:
    """Words between runs of white space; none for a blank name."""
    return F.filter(F.split(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), " "), lambda x: x != "")


def _last(t: Column) -> Column:
    return F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(""))


def _first(t: Column) -> Column:
    return F.coalesce(F.try_element_at(t, F.lit(1)), F.lit(""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_name(name: Column) -> Column:
    """Without trailing corporate suffixes and punctuation, runs of blanks as one; null is empty."""
    return F.regexp_replace(F.regexp_replace(_strip(F.coalesce(name, F.lit(""))), _CLEAN, ""), r"(?U)\s+", " ")


def normalize_name(name: Column) -> Column:
    """Lower case without parentheses, leading titles, trailing suffixes and filler words; what was there before if nothing is left."""
    plain = F.btrim(F.regexp_replace(_strip(F.lower(name)), r"\(.*?\)", ""), F.lit(".,;:()[]'\" "))
    joined = F.concat(F.lit(" "), F.array_join(tokens(plain), " "), F.lit(" "))
    joined = F.regexp_replace(joined, rf"^(?: (?:{'|'.join(TITLES)})(?= ))+", "")
    joined = F.regexp_replace(joined, rf"(?:(?<= )(?:{'|'.join(SUFFIXES)}) )+$", "")
    kept = F.array_join(F.filter(tokens(joined), lambda x: ~x.isin(NOISE)), " ")
    return F.when(kept != "", kept).otherwise(plain)


def clean_extraction_name(name: Column) -> Column:
    n = F.btrim(_strip(F.regexp_replace(_strip(name), EXTRACTION_NOISE, "")), F.lit(".,;:'\"- "))
    return F.when(F.length(n) < 3, F.lit("")).otherwise(n)


def fuzzy_last_name(a: Column, b: Column) -> Column:
    """Whether two names may be one person's, by first letters and surname; not symmetric in its last test."""
    p, q = tokens(F.lower(a)), tokens(F.lower(b))
    x, y = (F.regexp_replace(_last(t), "-+$", "") for t in (p, q))
    n, m = F.length(x), F.length(y)
    grams = F.exists(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.contains(y, F.substr(x, i, F.lit(4))))
    return (
        F.when((F.size(p) < 2) | (F.size(q) < 2), False)
        .when(F.substring(_first(p), 1, 3) != F.substring(_first(q), 1, 3), False)
        .when((n <= 4) | (m <= 4), x == y)
        .when(x.startswith(y) | y.startswith(x), True)
        .when(F.substring(x, 1, 4) == F.substring(y, 1, 4), F.abs(n - m) <= 3)
        .when(F.substring(x, 1, 2) == F.substring(y, 1, 2), grams)
        .otherwise(False)
    )


def inventor_norm(name: Column) -> Column:
    s = F.regexp_replace(_strip(F.lower(F.coalesce(name, F.lit("")))), "’", "'")
    s = F.regexp_replace(s, r"\b(jr|sr)\.?\b", "$1")
    return F.btrim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9' -]", " "), r"\s+", " "), F.lit(" .,"))


def resolver_norm(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]", ""))


def is_upper(s: Column) -> Column:
    """At least one letter with case, and none of them lower."""
    return (F.upper(s) == s) & (F.lower(s) != s)


def title_case(s: Column) -> Column:
    """Each run of letters with a capital and the rest small."""
    parts = F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def flip_filing_name(name: Column) -> Column:
    """LAST FIRST MIDDLE as First Middle Last, if the first word is all capitals and every word starts with a letter."""
    t = tokens(name)
    ok = (F.size(t) >= 2) & is_upper(_first(t)) & (F.length(_first(t)) > 1) & F.forall(t, lambda x: x.rlike(r"^\p{L}"))
    return F.when(ok, F.concat_ws(" ", title_case(F.array_join(F.slice(t, 2, 1000), " ")), title_case(_first(t)))).otherwise(name)


def looks_like_person(name: Column) -> Column:
    return ~name.rlike(rf"(?i)\b({ORG_WORDS})\b") & ~name.rlike(r"(?U)\d") & F.size(tokens(name)).between(2, 3)


def person_like(name: Column) -> Column:
    return ~name.rlike(rf"(?i)\b({ORG_WORDS_RESOLVER})\b") & ~name.rlike(r"(?U)\d") & F.size(tokens(name)).between(2, 4)


def looks_org(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(rf"(?i)\b({ORG_WORDS_PATENT})\b")


def classify_basic(name: Column, location_prefixes: Sequence[str] = ()) -> Column:
    """person, org, location or unknown; location_prefixes: own names of places."""
    n = _strip(F.lower(name))
    out = F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(n.rlike(r"^[\d\-\(\)\s]{7,}$"), "location").when(F.arrays_overlap(tokens(n), F.array(*map(F.lit, LOCATION_WORDS))), "location")
    for p in location_prefixes:
        out = out.when(n.startswith(p), "location")
    return out.when(n.rlike(r"(?:trust|trust #2|trust #3|foundation)$"), "org").when(n.startswith("the "), "org").otherwise("person")


def classify_index(name: Column) -> Column:
    """person, company, organization or entity, by the words of a name."""
    t = tokens(name)
    capital = F.forall(t, lambda x: x.rlike(r"^\p{Lu}") | (x == "&"))
    return F.when(F.size(t) <= 1, "person").when(F.lower(_last(t)).isin(COMPANY_ENDS), "company").when(F.arrays_overlap(t, F.array(*map(F.lit, ORG_PARTS))), "organization").when(_last(t).rlike(r"^\p{Lu}") & capital, "person").otherwise("entity")


def is_fragment(name: Column) -> Column:
    t = tokens(name)
    n, k = F.size(t), F.length(_last(t))
    return F.when(n == 0, True).when((n == 1) & (F.length(_first(t)) <= 3), True).when((n >= 2) & (k == 1), True).when((n >= 2) & (k <= 3), ~F.lower(_last(t)).isin(SHORT_SURNAMES)).otherwise(F.exists(t, lambda x: F.length(x) > 15))


def is_obviously_bad(name: Column) -> Column:
    n = _strip(name)
    low, t = F.lower(n), tokens(name)
    words, k, last = tokens(low), F.size(t), F.lower(_last(t))
    phrase = F.lit(False)
    for p in BAD_PHRASES:
        phrase = phrase | low.contains(p)
    return (
        F.when(n == "", True)
        .when(n.rlike(r"^[\d()\- ]+$"), True)
        .when(n.rlike(r"^\p{Ll}"), True)
        .when(F.arrays_overlap(words, F.array(*map(F.lit, ORG_PARTS))), False)
        .when(phrase, True)
        .when(last.isin(NON_NAMES) & (k > 3), True)
        .when((k == 1) & last.isin(NON_NAMES), True)
        .when(k > 6, True)
        .when(low.rlike(rf"^(?:{'|'.join(STARTERS)}) "), True)
        .when(n.rlike("[#/]") & ~n.rlike(r"\p{L}"), True)
        .when((F.length(n) - F.length(F.replace(n, F.lit(","), F.lit(""))) == 1) & (F.size(tokens(F.substring_index(n, ",", 1))) <= 2), True)
        .otherwise(False)
    )


def real_name(name: Column) -> Column:
    """A person's name in ordinary writing, for enrichment."""
    t = tokens(name)
    return ~is_upper(name) & (F.size(t) >= 2) & (F.length(_first(t)) > 2) & ~_first(t).endswith(".")


def safe_match(raw: Column, collisions: Column) -> Column:
    t = tokens(inventor_norm(raw))
    k = F.length(_last(t))
    return F.coalesce((collisions == 1) & (F.size(t) > 0) & (raw.contains("-") | ((F.size(t) == 2) & (k >= 8)) | ((F.size(t) >= 3) & (k >= 7))), F.lit(False))


def distinctive(raw: Column) -> Column:
    t = tokens(inventor_norm(raw))
    return (F.size(t) >= 3) | ((F.size(t) == 2) & F.exists(t, lambda x: F.length(x) >= 8))


def high_confidence(raw: Column, collisions: Column, degree: Column, least_degree: int = 300) -> Column:
    return F.coalesce((inventor_norm(raw) != "") & (collisions == 1) & (distinctive(raw) | (F.coalesce(degree, F.lit(0)) >= least_degree)), F.lit(False))


def slug(name: Column) -> Column:
    return F.translate(F.upper(name), " .,", "_")

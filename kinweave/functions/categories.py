"""Relation categories: which of 27 a relation type belongs to, and how likely each makes a call."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Ordered rules; the first that holds decides. is: equal to one of; starts: begins with; has: contains one of.
RULES: list[tuple[str, str, str]] = [
    ("SAME_ENTITY", "is", "ALIAS,FORMER_NAME"),
    ("SAME_ORG_OVERLAP", "is", "SAME_ORG_OVERLAP"),
    ("SAME_SCHOOL_OVERLAP", "is", "SAME_SCHOOL_OVERLAP"),
    ("CO_INVENTOR", "is", "CO_INVENTOR"),
    ("PATENT_ASSIGNED_TO", "is", "PATENT_ASSIGNED_TO"),
    ("CO_DIRECTOR", "starts", "DIRECTOR"),
    ("CO_DIRECTOR", "is", "CO_DIRECTOR,INDEPENDENT_DIRECTOR,NON-EXECUTIVE_DIRECTOR,LEAD_DIRECTOR,BOARD_OF_DIRECTORS,BOARD_MEMBER,BOARD,BOARD_CHAIR,BOARD_MEMBER_OF,LEAD_INDEPENDENT_DIRECTOR,CHAIRMAN_OF_THE_BOARD,CHAIRMAN_(BOARD_OF_DIRECTORS)"),
    ("CO_OFFICER", "starts", "OFFICER"),
    ("CO_OFFICER", "is", "CO_OFFICER"),
    ("CO_EXECUTIVE", "is", "POSITION,CHIEF_FINANCIAL_OFFICER,CHIEF_EXECUTIVE_OFFICER,CHIEF_OPERATING_OFFICER,CHIEF_ACCOUNTING_OFFICER,CHIEF_INVESTMENT_OFFICER,CHIEF_TECHNOLOGY_OFFICER,CHIEF_INFORMATION_OFFICER,CHIEF_ADMINISTRATIVE_OFFICER,EXECUTIVE_OFFICER,EXECUTIVE_DIRECTOR,EXECUTIVE_CHAIRMAN,MANAGING_PARTNER,GENERAL_PARTNER,FOUNDING_PARTNER,CO_FOUNDER,CO-FOUNDER,FOUNDING_MEMBER"),
    ("CO_EXECUTIVE", "has", "CEO,CFO,COO,CIO,CTO,PRESIDENT,CHAIRMAN,CHAIR,VICE_PRESIDENT,EXECUTIVE,SVP,EVP, VP,TREASURER,SECRETARY,GENERAL_COUNSEL,COMPTROLLER,CONTROLLER,MANAGING_DIRECTOR,PRINCIPAL,PARTNER,FOUNDER,OWNER,PROVOST,CHANCELLOR,DEAN,REGENT,OVERSEER"),
    ("DONATION", "is", "DONATION,FUNDRAISING,BUNDLER,MAJOR_CONTRIBUTOR,CONTRIBUTOR"),
    ("CO_OCCURS_DOC", "is", "TRANSACTED_WITH"),
    ("NEWS_COMENTION", "is", "MENTIONED_WITH"),
    ("COMMUNICATED", "is", "COMMUNICATED_WITH"),
    ("FAMILY", "is", "FAMILY,SPOUSE"),
    ("FRIEND", "is", "FRIEND,CLOSE_FRIEND,LONGTIME_FRIEND,GOOD_FRIEND,PERSONAL_FRIEND,OLD_FRIEND,CHILDHOOD_FRIEND,A_FRIEND,BOYFRIEND,GIRLFRIEND,ROMANTIC_PARTNER,CLOSEST_FRIEND,INTIMATE_FRIEND,DEAR_FRIEND,WEALTHY_FRIEND"),
    ("EDUCATION", "is", "EDUCATION,ALMA_MATER,ALUMNI,ALUMNI_OF,EDUCATED_AT"),
    ("MEMBERSHIP", "is", "MEMBERSHIP,MEMBER,MEMBER_OF,AFFILIATED_WITH,ASSOCIATED_WITH,FOUNDING_MEMBER"),
    ("ADVISORY", "is", "TRUSTEE,ADVISORY_BOARD_MEMBER,ADVISORY_BOARD,ADVISOR,ADVISER,SENIOR_ADVISOR,SENIOR_ADVISER,ADVISORY_COUNCIL_MEMBER"),
    ("EMPLOYMENT", "is", "EMPLOYER,EMPLOYEE,EMPLOYED_BY,PROFESSIONAL"),
    ("FINANCIAL", "is", "PAID_BY,GRANTED_TO,LP_COMMITMENT,INVESTOR"),
    ("TRAVEL_MET", "is", "TRAVELED_TO,MET_WITH"),
    ("FELLOW_OFFICEHOLDER", "is", "FELLOW_GOVERNOR,FELLOW_JUDGE,FELLOW_JUSTICE"),
    ("PUBLIC_OFFICE", "is", "MEMBER_OF_CONGRESS,SENATOR,GOVERNOR,REPRESENTATIVE,STATE_SENATOR,STATE_REPRESENTATIVE,MAYOR,ATTORNEY_GENERAL,LIEUTENANT_GOVERNOR,JUSTICE,JUDGE,APPELLATE_JUDGE,ASSOCIATE_JUSTICE,PRESIDENT_OF_THE_UNITED_STATES,COMMISSIONER,SECRETARY_OF_STATE,AMBASSADOR"),
    ("LOBBYING", "is", "LOBBYING,LOBBYIST"),
    ("SEC_INSIDER", "is", "INSIDER,TEN_PERCENT_OWNER,FILER,HELD,CONTROLLED_BY"),
    ("STAFF_AIDE", "has", "STAFF,AIDE,CHIEF_OF_STAFF,CAMPAIGN,LEGISLATIVE,PRESS_SECRETARY,SCHEDULER,SPEECHWRITER,COUNSELOR,INTERN"),
    ("WEAK_SOCIAL", "is", "MENTOR,MENTEE,NEIGHBOR,ACQUAINTANCE,COLLEAGUE,ROOMMATE,CLASSMATE,COLLEGE_ROOMMATE,PARTY_HOST"),
    ("EMPLOYMENT", "has", "PROFESSOR,FACULTY,LECTURER,INSTRUCTOR,SCHOLAR_IN_RESIDENCE,FELLOW_IN_RESIDENCE,RESEARCHER,POSTDOC"),
    ("EMPLOYMENT", "has", "LAW_CLERK,CLERK,COUNSEL,ATTORNEY,ASSOCIATE,CONSULTANT"),
    ("ADVISORY", "has", "TRUSTEE,BOARD_OF_TRUSTEES,BOARD_OF_ADVISORS,BOARD_OF_GOVERNORS,BOARD_OF_VISITORS,ADVISORY_BOARD,ADVISOR,ADVISER,BOARD_OF_OVERSEERS"),
    ("MEMBERSHIP", "has", "FELLOW"),
    ("MEMBERSHIP", "has", "COMMITTEE_MEMBER,COUNCIL_MEMBER,MEMBER,DELEGATE,RANKING_MEMBER,COMMITTEE,COUNCIL,DELEGATION"),
    ("MEMBERSHIP", "is", "CO-SPONSOR,CO_SPONSOR,COSPONSOR,BILL_COSPONSOR"),
    ("PUBLIC_OFFICE", "has", "CANDIDATE,NOMINEE,PARLIAMENTARY"),
]
# Probability that a call is taken, given this category alone.
PROBABILITY = {
    "FAMILY": 0.92, "FRIEND": 0.90, "COMMUNICATED": 0.80, "CO_EXECUTIVE": 0.87, "CO_DIRECTOR": 0.87, "CO_OFFICER": 0.90, "EMPLOYMENT": 0.70, "TRAVEL_MET": 0.70,
    "ADVISORY": 0.70, "MEMBERSHIP": 0.50, "EDUCATION": 0.50, "DONATION": 0.10, "FINANCIAL": 0.60, "LOBBYING": 0.80, "STAFF_AIDE": 0.90, "PUBLIC_OFFICE": 0.60,
    "FELLOW_OFFICEHOLDER": 0.75, "SEC_INSIDER": 0.50, "NEWS_COMENTION": 0.10, "CO_OCCURS_DOC": 0.05, "WEAK_SOCIAL": 0.20, "SAME_ORG_OVERLAP": 0.18,
    "SAME_SCHOOL_OVERLAP": 0.12, "CO_INVENTOR": 0.68, "PATENT_ASSIGNED_TO": 0.55, "OTHER": 0.05,
}
#: Categories that stem from one shared employer and count once.
CO_EMPLOYMENT = ("CO_DIRECTOR", "CO_EXECUTIVE", "CO_OFFICER", "EMPLOYMENT", "SAME_ORG_OVERLAP", "SEC_INSIDER")


def normal(relation: Column) -> Column:
    """What the rules compare."""
    return F.trim(F.upper(F.coalesce(relation, F.lit(""))))


def categorize(relation: Column) -> Column:
    return category(normal(relation))


def category(r: Column, values: dict | None = None) -> Column:
    """The category of a relation in normal form, or what values has for it."""
    out = None
    for name, how, words in RULES:
        words = words.split(",")
        if how == "is":
            test = r.isin(words)
        elif how == "starts":
            test = r.startswith(words[0])
        else:
            test = r.rlike("|".join(words))
        value = F.lit(values[name] if values else name)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(values["OTHER"] if values else "OTHER"))


def categorize_sql(relation: str) -> str:
    """The same rules as ANSI SQL."""
    r = f"trim(upper(coalesce({relation}, '')))"
    parts = []
    for category, how, words in RULES:
        words = words.split(",")
        if how == "is":
            test = f"{r} IN ({', '.join(repr(w) for w in words)})"
        elif how == "starts":
            test = f"{r} LIKE '{words[0]}%'"
        else:
            test = " OR ".join(f"contains({r}, '{w}')" for w in words)
        parts.append(f"WHEN {test} THEN '{category}'")
    return f"CASE {' '.join(parts)} ELSE 'OTHER' END"


def dimension(spark: SparkSession) -> DataFrame:
    """(category, probability, co_employment): 26 rows."""
    return spark.createDataFrame([(k, p, k in CO_EMPLOYMENT) for k, p in PROBABILITY.items()], "category string, probability double, co_employment boolean")


#: Titles of relation types in the interface; a type that isn't here is its own title.
RELATION_TITLES = {
    "COMMUNICATED_WITH": "Communication", "TRANSACTED_WITH": "Financial Transaction", "ASSOCIATED_WITH": "Association", "AFFILIATED_WITH": "Affiliation", "PAID_BY": "Financial Payment", "CONTROLLED_BY": "Control",
    "EMPLOYED_BY": "Employment", "REPRESENTED_BY": "Representation", "TRAVELED_TO": "Travel", "MENTIONED_WITH": "Co-mentioned in News", "BOARD_MEMBER": "Board Member", "DIRECTOR": "Director", "PRESIDENT": "President",
    "CHAIRMAN": "Chairman", "CEO": "CEO", "OFFICER": "Officer", "FOUNDER": "Founder", "EMPLOYER": "Employer", "ALMA_MATER": "Alma Mater", "MEMBER_OF": "Member", "POSITION": "Position Held", "DONATION": "Donation",
    "MEMBERSHIP": "Membership", "CO_DIRECTOR": "Co-Director", "CO_OFFICER": "Co-Officer", "ALUMNI_OF": "Alumnus", "BOARD_MEMBER_OF": "Board Member", "VISITING_PROFESSOR": "Visiting Professor", "FELLOW_JUDGE": "Fellow Judge",
    "FELLOW_JUSTICE": "Fellow Justice", "FELLOW_GOVERNOR": "Fellow Governor",
}


def relation_info(relations: DataFrame, column: str = "relation_type") -> DataFrame:
    """relations with title: the interface's name of a relation type, or the type itself."""
    titles = F.create_map(*(F.lit(x) for kv in RELATION_TITLES.items() for x in kv))
    return relations.withColumn("title", F.coalesce(F.try_element_at(titles, F.col(column)), F.col(column)))


def category_info(categories: DataFrame, column: str = "category") -> DataFrame:
    """categories with probability; an unknown one has that of OTHER."""
    probs = F.create_map(*(F.lit(x) for kv in PROBABILITY.items() for x in kv))
    return categories.withColumn("probability", F.coalesce(F.try_element_at(probs, F.col(column)), F.lit(PROBABILITY["OTHER"])))

"""Files: CSV, TSV, JSON lines, caches and registries, with explicit schemas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..functions.names import slug
from ..functions.roles import document_relation, document_type, fund_type


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns named by a trimmed, lower-cased header with _ for blanks."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))


def pension_commitments(spark: SparkSession, path: str) -> DataFrame:
    return commitments(_csv(spark, path))


def commitments(df: DataFrame) -> DataFrame:
    """(pension_fund, fund_name, amount, vintage_year, asset_class) of text columns in either spelling; rows without a fund go, what isn't a whole number is 0."""
    blank = lambda n: F.nullif(F.trim(F.col(n)), F.lit(""))
    pick = lambda *names: F.coalesce(*(blank(n) for n in names if n in df.columns), F.lit(None).cast("string"))
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    asset = F.coalesce(F.trim("asset_class"), F.lit("")) if "asset_class" in df.columns else F.lit("Venture Capital")
    asset = F.coalesce(pick("assetclass"), asset)
    out = df.select(pick("pensionfund", "pension_fund").alias("pension_fund"), pick("fundname", "fund_name").alias("fund_name"), number(pick("commitmentamount", "commitment_amount")).alias("amount"), number(pick("vintageyear", "vintage_year")).cast("int").alias("vintage_year"), asset.alias("asset_class"))
    return out.where("pension_fund IS NOT NULL AND fund_name IS NOT NULL")


def commitment_relationships(commitments: DataFrame) -> DataFrame:
    return commitments.select(slug(F.col("pension_fund")).alias("source_id"), F.col("pension_fund").alias("source_name"), F.lit("NONPROFIT").alias("source_type"), slug(F.col("fund_name")).alias("target_id"), F.col("fund_name").alias("target_name"), fund_type(F.col("asset_class")).alias("target_type"), F.lit("LP_COMMITMENT").alias("relation_type"))


def persons_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.PERSON_CSV).csv(path, header=True)
    return df.select(*(F.trim(c).alias(c) for c in df.columns)).where("name <> ''")


def document_graph(nodes: DataFrame, edges: DataFrame, min_confidence: float = 0.9) -> DataFrame:
    """Typed edges of a document graph above a confidence, without place-to-place ones, surest first."""
    n = nodes.select("node_id", "node_type")
    rows = edges.where(F.col("confidence") >= min_confidence).join(n.toDF("source_node_id", "source_kind"), "source_node_id").join(n.toDF("target_node_id", "target_kind"), "target_node_id")
    rows = rows.where("NOT (source_kind = 'Location' AND target_kind = 'Location')")
    return rows.select(F.col("source_label").alias("source_name"), document_type(F.col("source_kind")).alias("source_type"), F.col("target_label").alias("target_name"), document_type(F.col("target_kind")).alias("target_type"), document_relation(F.col("edge_type")).alias("relation_type"), "confidence").orderBy(F.desc("confidence"), "source_name", "target_name")


def news_mentions(spark: SparkSession, path: str, cap: int = 20_000) -> DataFrame:
    """(article, person) of tab-separated files: column 12 has names parted by semicolons; cap rows of each file, without its header."""
    rows = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("_id"))).where(F.col("_n").between(2, cap + 1))
    people = F.try_element_at(F.split("value", "\t"), F.lit(12))
    return rows.select(F.concat_ws("#", "file", "_n").alias("article"), F.explode(F.transform(F.split(people, ";"), F.trim)).alias("person")).where("person <> ''")


def patents(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path)


def resolutions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESOLUTION).json(path, mode="DROPMALFORMED").where("name IS NOT NULL")


def overlaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OVERLAP).json(path, mode="DROPMALFORMED").where("a IS NOT NULL AND b IS NOT NULL")


def scored_graph(payloads: DataFrame, legacy: bool = False) -> DataFrame:
    """(a, b, prob, cats) of graph JSON {nodes, edges: [[u, v, p, cats]]}; the legacy form [u, v, relation] gets probability 0.5."""
    g = F.try_parse_json("payload")
    nodes = F.try_variant_get(g, "$.nodes", "array<string>")
    rows = payloads.select(nodes.alias("nodes"), F.explode(F.try_variant_get(g, "$.edges", "array<variant>")).alias("e"))
    get = lambda i, t: F.try_variant_get("e", f"$[{i}]", t)
    name = lambda i: F.try_element_at("nodes", get(i, "int") + 1)
    if legacy:
        prob, cats = F.lit(0.5), F.array(get(2, "string"))
    else:
        prob, cats = get(2, "double"), get(3, "array<string>")
    return rows.select(F.least(name(0), name(1)).alias("a"), F.greatest(name(0), name(1)).alias("b"), prob.alias("prob"), cats.alias("cats")).where("a IS NOT NULL AND b IS NOT NULL")


def deceased(payloads: DataFrame) -> DataFrame:
    """(name_lower, death_date) of a JSON map; bad JSON gives none."""
    return payloads.select(F.explode(F.from_json("payload", "map<string,string>")).alias("k", "death_date")).select(F.lower("k").alias("name_lower"), "death_date")


def evidence_index(payloads: DataFrame) -> DataFrame:
    """(src, tgt, rel, source, snippet, doc, page, url) of a JSON map keyed src|tgt|rel."""
    rows = payloads.select(F.explode(F.from_json("payload", "map<string,array<struct<source:string,snippet:string,doc:string,page:string,url:string>>>")).alias("k", "items")).select(F.split("k", r"\|").alias("k"), F.explode("items").alias("e"))
    return rows.select(F.col("k")[0].alias("src"), F.col("k")[1].alias("tgt"), F.col("k")[2].alias("rel"), "e.*")


def contacts(spark: SparkSession, path: str) -> DataFrame:
    return contact_lines(spark.read.text(path))


def contact_lines(lines: DataFrame) -> DataFrame:
    """(contact) of card or CSV lines (value): FN:name, N:last;first, or the first two cells; longer than three letters."""
    v = F.trim("value")
    n = F.split(F.regexp_replace(v, "^N[^:]*:", ""), ";")
    cells = F.split(v, ",")
    name = (
        F.when(v.rlike("^FN[^:]*:"), F.regexp_replace(v, "^FN[^:]*:", ""))
        .when(v.rlike("^N[;:]"), F.concat_ws(" ", F.try_element_at(n, F.lit(2)), n[0]))
        .when(v.contains(",") & ~v.rlike("^(?:EMAIL|TEL)"), F.concat_ws(" ", F.trim(cells[0]), F.trim(cells[1])))
    )
    return lines.select(F.trim(name).alias("contact")).where("length(contact) > 3").distinct()


def sampled_files(listing: DataFrame) -> DataFrame:
    """(month, file): of each month's files (file, day) the middle one of the 15th, else the month's first."""
    rows = listing.withColumn("month", F.date_trunc("month", "day").cast("date"))
    mid = rows.where(F.dayofmonth("day") == 15)
    w = Window.partitionBy("month")
    mid = mid.withColumn("_n", F.row_number().over(w.orderBy("file"))).withColumn("_k", F.count("*").over(w)).where("_n = _k div 2 + 1").select("month", "file")
    first = rows.groupBy("month").agg(F.min_by("file", F.struct("day", "file")).alias("first"))
    return first.join(mid, "month", "left").select("month", F.coalesce("file", "first").alias("file"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGISTRY).csv(path, header=True)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Relationships listed in a JSON lines file of one's own."""
    return spark.read.schema(schemas.RELATIONSHIP).json(path, mode="DROPMALFORMED")

"""Scans of JSON documents: taxonomy, curated patterns, records, questions, office settings, page cache.

Schemas are given, so no scan reads its input twice; fields that a schema does not name are dropped, and
a broken file gives a row with `_corrupt_record` where the caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import RECORD

CATEGORY = "id string, bn string, en string, office string, sources array<string>, aliases array<string>, ingest_tier string, mvp_priority int, apply_portal string, note string"
PATTERN = "id string, category string, kind string, claim_bn string, claim_en string, why_it_matters_en string, source_url string, source_document string, source_date date, verified_by string, confidence string, caveat string"
QUESTION = "id string, query string, lang string, kind string, expect_category string, must_contain array<string>, must_not_contain array<string>, note string"
OFFICE = "office_id string, office string, charter_url string, published date, apply_portal string, accept_categories array<string>"
FETCHED = "url string, final_url string, status int, content_type string, bytes long, fetched_at timestamp, tls_verified boolean, tls_skip_reason string"


def _listed(spark: SparkSession, path: str, field: str, row: str) -> DataFrame:
    """Rows of the array `field` of one JSON document, with their place in it."""
    struct = row.replace(" array<", ":array<")
    struct = ",".join(":".join(part.strip().split(" ", 1)) if ":" not in part else part.strip() for part in struct.split(", "))
    doc = spark.read.option("multiLine", True).schema(f"{field} array<struct<{struct}>>").json(path)
    return doc.select(F.posexplode(field).alias("pos", "r")).select("pos", "r.*")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "categories", CATEGORY)


def patterns(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "patterns", PATTERN)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "questions", QUESTION)


def offices(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "offices", OFFICE)


def aliases(categories: DataFrame, named: bool = False) -> DataFrame:
    """(category, alias, pos): the aliases of each category, which tell a question's; with `named` its Bengali name after them, as overlaps are looked for."""
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    names = F.concat(own, F.array("bn")) if named else own
    return categories.select(F.col("id").alias("category"), F.posexplode(names).alias("pos", "alias")).where("alias is not null")


def records(spark: SparkSession, path: str, broken: bool = False) -> DataFrame:
    """One row per record file; broken files are rows with `_corrupt_record` if asked for, else they fail the scan."""
    schema = RECORD + (", _corrupt_record string" if broken else "")
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE" if broken else "FAILFAST").schema(schema).json(path)


def pdf_catalogue(spark: SparkSession, path: str, per_office: int = 4) -> DataFrame:
    """(office, pos, url) of the first `per_office` addresses of each office in a JSON map."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return doc.select(F.explode("m").alias("office", "urls")).select("office", F.posexplode(F.slice("urls", 1, per_office)).alias("pos", "url"))


def fetched(spark: SparkSession, bodies: str, meta: str) -> DataFrame:
    """The page cache: raw bodies joined with their JSON side files by file stem; nothing is fetched."""
    stem = F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]+$", 1)
    body = spark.read.format("binaryFile").load(bodies).select(stem.alias("stem"), F.col("content").alias("body"))
    side = spark.read.option("multiLine", True).schema(FETCHED).json(meta).withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(?:\.meta)?\.json$", 1))
    return side.join(body, "stem")


def index(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """What sinks.write_index wrote; of the named categories only their folders are read."""
    chunks = spark.read.parquet(path)
    return chunks if categories is None else chunks.where(F.col("category").isin(*categories))


def last_facts(spark: SparkSession, path: str, before: str) -> DataFrame:
    """Of dated snapshots of page facts (run_date, url, ...), each page's last one before a day."""
    seen = spark.read.parquet(path).where(F.col("run_date") < F.lit(before).cast("date"))
    last = F.max_by(F.struct(*[F.col(c) for c in seen.columns]), "run_date")
    return seen.groupBy("url").agg(last.alias("r")).select("r.*")


def checklists(spark: SparkSession, path: str, labels: dict[str, str]) -> DataFrame:
    """(section, pos, doc) of a JSON map of sections to documents; a section with a label puts it before each of them."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    named = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else F.create_map().cast("map<string,string>")
    rows = m.select(F.explode("m").alias("section", "docs")).select("section", F.posexplode("docs").alias("pos", "doc"))
    return rows.withColumn("doc", F.concat(F.coalesce(F.concat(F.try_element_at(named, F.col("section")), F.lit(": ")), F.lit("")), "doc"))

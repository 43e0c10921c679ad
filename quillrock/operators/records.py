"""Nested service records: schema, chunks, constraints, warnings, counts. Offices' rows are folded in offices.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled

RECORD = """category string, service_name_en string, service_name_bn string, office string, locality string,
variants array<struct<variant_id:string,label_en:string,label_bn:string,required_docs:array<struct<doc:string,mandatory:boolean,source_url:string>>,steps:array<struct<step:string,where:string,source_url:string>>>>,
fees array<struct<fee_key:string,label_en:string,label_bn:string,amount_bdt:decimal(18,2),includes_vat:boolean,source_url:string,source_document:string,source_last_updated:date,raw_text:string,verification:struct<status:string,verified_by:string,verified_date:date,method:string>>>,
office_location string, contact string, apply_portal string, source_url string, last_scraped_date date, source_last_updated date,
verification struct<status:string,verified_by:string,verified_date:date,method:string>, notes array<string>"""
FIELDS = (
    "category", "service_name_en", "service_name_bn", "office", "locality", "variants", "fees", "office_location", "contact", "apply_portal", "source_url", "last_scraped_date",
    "source_last_updated", "verification", "notes",
)
STALE_DAYS = 90


def chunks(records: DataFrame) -> DataFrame:
    """(id, category, chunk_kind, text): identity, steps and documents per variant, fee labels. Never an amount."""
    cat, bn, en = F.col("category"), F.col("service_name_bn"), F.col("service_name_en")
    row = lambda i, kind, text: F.struct(i.alias("id"), F.lit(kind).alias("chunk_kind"), text.alias("text"))
    identity = F.array(row(F.concat(cat, F.lit("::identity")), "identity", F.concat_ws(" | ", bn, en, "office")))
    head = lambda v: F.concat(bn, F.lit(" "), F.coalesce(v["label_en"], F.lit("")))

    def steps(v):
        body = F.array_join(F.transform(v["steps"], lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["step"])), " ")
        return row(F.concat(cat, F.lit("::"), v["variant_id"], F.lit("::steps")), "steps", F.concat(head(v), F.lit(" — process: "), body))

    def documents(v):
        return F.transform(v["required_docs"], lambda d, i: row(F.concat(cat, F.lit("::"), v["variant_id"], F.lit("::doc"), i.cast("string")), "required_doc", F.concat(head(v), F.lit(" — required document: "), d["doc"])))

    with_steps = F.transform(F.filter("variants", lambda v: F.size(v["steps"]) > 0), steps)
    docs = F.flatten(F.transform(F.filter("variants", lambda v: F.size(v["required_docs"]) > 0), documents))
    labels = F.array_join(F.transform("fees", lambda f: filled(f["label_en"], f["label_bn"], f["fee_key"])), " / ")
    fees = F.when(F.size("fees") > 0, F.array(row(F.concat(cat, F.lit("::fee_labels")), "fee_labels", F.concat(bn, F.lit(" "), en, F.lit(" — fee categories: "), labels))))
    parts = F.concat(*(F.coalesce(p, F.array().cast("array<struct<id:string,chunk_kind:string,text:string>>")) for p in (identity, with_steps, docs, fees)))
    return records.select("category", F.explode(parts).alias("c")).select("c.id", "category", "c.chunk_kind", "c.text")


def broken_rules(records: DataFrame) -> DataFrame:
    """(category, rule) for each broken rule of a fee or a record's source."""
    url = filled(F.col("source_url")).isNull()
    fee = records.select("category", F.explode("fees").alias("f"))
    broken = fee.select(
        "category",
        F.explode(F.filter(F.array(
            F.when(F.col("f.amount_bdt").isNotNull() & (F.col("f.verification.status") == "unverified"), "amount_without_verification"),
            F.when(F.col("f.amount_bdt").isNull() & (F.col("f.verification.status") != "unverified"), "verified_without_amount"),
            F.when(F.col("f.amount_bdt").isNotNull() & filled(F.col("f.source_url")).isNull(), "fee_without_source"),
        ), lambda r: r.isNotNull())).alias("rule"),
    )
    return broken.unionByName(records.where(url).select("category", F.lit("record_without_source").alias("rule")))


def violations(records: DataFrame, valid: DataFrame) -> DataFrame:
    """(category, rule) for each broken rule of a record or a fee, and for unknown categories; an empty result passes."""
    unknown = records.join(valid.select(F.col("id").alias("category")), "category", "left_anti").select("category", F.lit("unknown_category").alias("rule"))
    return unknown.unionByName(broken_rules(records))


def scam_texts(records: DataFrame, words: tuple[str, ...], exempt: str) -> DataFrame:
    """(category, rule) of records that hold a word of the curated table anywhere, unless they hold the exempting phrase."""
    blob = F.lower(F.to_json(F.struct(*[F.col(c) for c in records.columns])))
    found = F.filter(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(blob, w))
    return records.where(~F.contains(blob, F.lit(exempt))).select("category", F.explode(found).alias("w")).select("category", F.concat(F.lit("scam_text:"), "w").alias("rule"))


def warnings(records: DataFrame, today: Column, days: int = STALE_DAYS) -> DataFrame:
    """(category, rule): old sources of records and of fees with an amount, and read records without a date."""
    age = F.datediff(today, "source_last_updated")
    own = F.when(F.col("source_last_updated").isNull() & (F.col("verification.status") != "unverified"), "undated_record").when(age > days, "old_record")
    record = records.select("category", own.alias("rule")).where("rule is not null")
    fee = records.select("category", F.explode("fees").alias("f")).where(F.col("f.amount_bdt").isNotNull() & (F.datediff(today, "f.source_last_updated") > days))
    return record.unionByName(fee.select("category", F.lit("old_fee").alias("rule")))


def severities(errors: DataFrame, warned: DataFrame) -> DataFrame:
    """(severity, n) of both kinds, 0 where there is none."""
    n = lambda df, name: df.agg(F.lit(name).alias("severity"), F.count(F.lit(1)).alias("n"))
    return n(errors, "error").unionByName(n(warned, "warning"))


def counts(records: DataFrame) -> DataFrame:
    """(category, n_fees, n_amounts, n_verified, n_docs)."""
    docs = F.flatten(F.transform("variants", lambda v: v["required_docs"]))
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return records.select(
        "category", size("fees").alias("n_fees"), size(F.filter("fees", lambda f: f["amount_bdt"].isNotNull())).alias("n_amounts"),
        size(F.filter("fees", lambda f: f["verification"]["status"] != "unverified")).alias("n_verified"), size(docs).alias("n_docs"),
    )


def valid_categories(categories: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """(id): what a record may be filed under."""
    return categories.select("id").unionByName(fallbacks.select("id")).distinct()


def urls_in_use(records: DataFrame) -> DataFrame:
    """(url, categories): every source of a record or of one of its fees, once, with the records that depend on it."""
    every = F.array_distinct(F.concat(F.array("source_url"), F.coalesce(F.transform("fees", lambda f: f["source_url"]), F.array().cast("array<string>"))))
    one = records.select("category", F.explode(every).alias("url")).where("url is not null")
    return one.groupBy("url").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def priority_gap(categories: DataFrame, priority: int = 1, want: int = 5) -> DataFrame:
    """One row with the number of categories of a priority if it is not the planned one."""
    return categories.agg(F.count_if(F.col("mvp_priority") == priority).alias("n")).where(F.col("n") != want)


def taxonomy_problems(categories: DataFrame, audited: DataFrame) -> DataFrame:
    """(id, severity, rule) of categories (id, sources, ingest_tier) against audited sources (url, reachable, likely_js)."""
    source = categories.select("id", F.explode("sources").alias("url")).join(audited, "url", "left")
    rule = F.when(F.col("reachable").isNull(), "not_audited").when(~F.col("reachable"), "not_reachable").when(F.col("likely_js"), "js_shell")
    named = source.select("id", F.when(rule == "js_shell", "warning").otherwise("error").alias("severity"), rule.alias("rule")).where("rule is not null")
    bare = categories.where(F.coalesce(F.size("sources"), F.lit(0)) <= 0)
    return (
        named.unionByName(bare.where("ingest_tier <> 'unmapped'").select("id", F.lit("error").alias("severity"), F.lit("no_sources").alias("rule")))
        .unionByName(bare.select("id", F.lit("warning").alias("severity"), F.lit("unmapped").alias("rule")))
    )


def taxonomy_rules(categories: DataFrame, reserved: tuple[str, ...] = ("unknown_service", "out_of_scope"), least: int = 3) -> DataFrame:
    """(id, rule) of categories (id, aliases array) whose id or aliases are not as they must be."""
    rules = F.array(
        F.when(~F.col("id").rlike("^[a-z][a-z0-9_]*$"), "not_snake_case"), F.when(F.col("id").isin(*reserved), "reserved"),
        F.when(F.coalesce(F.size("aliases"), F.lit(0)) < least, "few_aliases"), F.when(~F.coalesce(F.exists("aliases", lambda x: x.rlike("[\u0980-\u09ff]")), F.lit(False)), "no_bengali_alias"),
    )
    return categories.select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))

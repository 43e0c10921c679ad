"""Records cut from source documents by a table of rules: sections, rows, fields.

A rule says for a kind of document where a section begins, what a row of it looks like and which fields it gives.
All rules of a kind come to its documents as one array (a broadcast of the rule table), and every document is cut in
its own row: no shuffle, and one plan for all kinds. A text is cut at every mark of a section, so a row belongs to the
last mark before it. A row whose amount cannot be read stays, unverified, with its raw text; a document of which
nothing can be read, or that has no rules, becomes a stub.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fees import split_numbered
from ..functions.text import to_ascii_digits, visible_text
from .html import tables

#: shape 'text': section and row are patterns of the visible text. shape 'table': rows of the first table with at
#: least `least_cells` cells, whose first cell fits `first` and whose label cell holds `term`.
RULE = """kind string, rule string, gives string, shape string, section string, section_groups int, row string, row_groups int, least_cells int, first string,
term string, label_cell int, value_cell int, amount string, free string, key string, label string, ord int"""
#: Rate cells of tables (fixed patterns).
TABLE_AMOUNT, TABLE_FREE, TABLE_ROW = r"([০-৯0-9]+)\s*টাকা", "বিনা ফিস", "^[০-৯]"
GROUPS = 4
LABEL, DOC, RAW = 300, 400, 600


def text_rule(kind: str, rule: str, row: str, key: str, label: str, amount: str, section: str = "", free: str = "", ord: int = 0) -> tuple:
    """Fees from text. {s1}.. are a section's groups, {r1}.. a row's, {n} the row's number; the key is put in lower case with underscores."""
    return (kind, rule, "fee", "text", section, re.compile(section).groups, row, re.compile(row).groups, 0, "", "", 0, 0, amount, free, key, label, ord)


def table_rule(kind: str, rule: str, key: str, least_cells: int = 3, first: str = "", term: str = "", label_cell: int = 1, value_cell: int = 2, amount: str = TABLE_AMOUNT, free: str = TABLE_FREE, ord: int = 0) -> tuple:
    """Fees from the rows of a table: the label is a cell, the value another."""
    return (kind, rule, "fee", "table", "", 0, "", 0, least_cells, first, term, label_cell, value_cell, amount, free, key, "", ord)


def docs_rule(kind: str, rule: str, first: str, cell: int, least_cells: int = 4, ord: int = 0) -> tuple:
    """Required documents from a cell of the rows that fit: a numbered list."""
    return (kind, rule, "doc", "table", "", 0, "", 0, least_cells, first, "", cell, cell, "", "", "", "", ord)


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """(kind, rules array): rules of a kind in order. Rules are configuration, some rows a kind."""
    one = spark.createDataFrame(rules, RULE)
    fields = [f for f in one.columns if f != "kind"]
    return one.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("ord", *(f for f in fields if f != "ord")))).alias("rules"))


def _group(text: Column, pattern: Column, i: int, groups: Column) -> Column:
    return F.when(groups >= i, F.call_function("regexp_extract", text, pattern, F.lit(i))).otherwise(F.lit(""))


def _sections(text: Column, rule: Column) -> Column:
    """array<struct<head, body>>: the text behind each mark; the whole text if the rule has no marks."""
    heads = F.regexp_extract_all(text, rule["section"], F.lit(0))
    bodies = F.call_function("split", text, rule["section"], F.lit(-1))
    cut = F.zip_with(heads, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda h, b: F.struct(h.alias("head"), b.alias("body")))
    return F.when(rule["section"] == "", F.array(F.struct(F.lit("").alias("head"), text.alias("body")))).otherwise(cut)


def _items(text: Column, table: Column, rule: Column) -> Column:
    """array<struct<head, label, raw>> of a rule's rows, in order."""
    found = F.flatten(F.transform(_sections(text, rule), lambda s: F.transform(F.regexp_extract_all(s["body"], rule["row"], F.lit(0)), lambda r: F.struct(s["head"].alias("head"), F.lit("").alias("label"), r.alias("raw")))))
    fits = lambda c: (
        (F.size(c) >= rule["least_cells"]) & F.call_function("rlike", F.coalesce(F.get(c, F.lit(0)), F.lit("")), rule["first"]) & F.contains(F.coalesce(F.get(c, rule["label_cell"]), F.lit("")), rule["term"])
    )
    cell = lambda c, at: F.trim(F.coalesce(F.get(c, at), F.lit("")))
    rows = F.transform(F.filter(table, fits), lambda c: F.struct(F.lit("").alias("head"), cell(c, rule["label_cell"]).alias("label"), cell(c, rule["value_cell"]).alias("raw")))
    return F.when(rule["shape"] == "text", found).otherwise(rows)


def _filled(template: Column, x: Column, rule: Column, n: Column) -> Column:
    for i in range(1, GROUPS + 1):
        template = F.replace(template, F.lit(f"{{s{i}}}"), _group(x["head"], rule["section"], i, rule["section_groups"]))
        template = F.replace(template, F.lit(f"{{r{i}}}"), _group(x["raw"], rule["row"], i, rule["row_groups"]))
    return F.replace(template, F.lit("{n}"), F.lpad(n.cast("string"), 2, "0"))


def _fee(x: Column, i: Column, rule: Column) -> Column:
    """One row's fee: free is 0, an amount is what its pattern finds, anything else is unread."""
    free = F.when(rule["free"] == "", F.lit(False)).otherwise(F.call_function("rlike", x["raw"], rule["free"]))
    digits = F.regexp_replace(to_ascii_digits(F.call_function("regexp_extract", x["raw"], rule["amount"], F.lit(1))), ",", "")
    amount = F.when(free, F.lit(0).cast("long")).otherwise(digits.try_cast("long"))
    key = F.regexp_replace(F.lower(_filled(rule["key"], x, rule, i + 1)), r"\s+", "_")
    label = F.when(rule["label"] == "", F.left(x["label"], F.lit(LABEL))).otherwise(_filled(rule["label"], x, rule, i + 1))
    return F.struct(key.alias("fee_key"), label.alias("label"), amount.alias("amount"), F.left(x["raw"], F.lit(RAW)).alias("raw_text"))


def cut(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """documents (doc_id, kind, url, html, updated) with `fees` and `required_docs`, read by the rules of their kind."""
    known = documents.join(F.broadcast(rules), "kind", "left")
    own = F.coalesce("rules", F.array().cast(rules.schema["rules"].dataType))
    read = known.withColumns({"__text": visible_text(F.col("html")), "__table": F.coalesce(F.get(tables(F.col("html")), F.lit(0)), F.array().cast("array<array<string>>")), "__rules": own})
    of = lambda gives: F.filter("__rules", lambda r: r["gives"] == gives)
    text, table = F.coalesce("__text", F.lit("")), F.col("__table")
    fees = F.flatten(F.transform(of("fee"), lambda r: F.transform(_items(text, table, r), lambda x, i: _fee(x, i, r))))
    docs = F.flatten(F.transform(of("doc"), lambda r: F.flatten(F.transform(_items(text, table, r), lambda x: F.transform(split_numbered(x["label"]), lambda d: F.left(d, F.lit(DOC)))))))
    return read.withColumns({"fees": fees, "required_docs": docs}).drop("__text", "__table", "__rules", "rules", "html")


def records(read: DataFrame, heads: DataFrame, today: Column, reader: str) -> DataFrame:
    """One record a document of `cut`, in the shape of records.RECORD; a document without fees, documents and steps is a stub.

    heads: (kind, category, service_name_en, service_name_bn, office, apply_portal, contact, steps array<struct<step, where>>,
    why): what the source's pages don't say; `why` is a stub's reason.
    """
    j = read.join(F.broadcast(heads), "kind")
    day, none = today.cast("date"), F.lit(None).cast("string")
    status = lambda s, by, on, how: F.struct(s.alias("status"), by.alias("verified_by"), on.alias("verified_date"), how.alias("method"))
    seen = lambda how: status(F.lit("source_read"), F.lit(reader), day, how)
    unread = lambda why: status(F.lit("unverified"), none, F.lit(None).cast("date"), why)
    fee = lambda f: F.struct(
        f["fee_key"].alias("fee_key"), f["label"].alias("label_en"), none.alias("label_bn"), f["amount"].cast("decimal(18,2)").alias("amount_bdt"), F.lit(None).cast("boolean").alias("includes_vat"),
        F.col("url").alias("source_url"), none.alias("source_document"), F.col("updated").alias("source_last_updated"), F.when(f["amount"].isNull(), f["raw_text"]).alias("raw_text"),
        F.when(f["amount"].isNull(), unread(F.lit("no amount could be read"))).otherwise(seen(F.lit("read by rule"))).alias("verification"),
    )
    steps = F.transform(F.coalesce("steps", F.array().cast("array<struct<step:string,where:string>>")), lambda s: F.struct(s["step"].alias("step"), s["where"].alias("where"), F.col("url").alias("source_url")))
    docs = F.transform("required_docs", lambda d: F.struct(d.alias("doc"), F.lit(True).alias("mandatory"), F.col("url").alias("source_url")))
    variant = F.struct(F.concat("kind", F.lit("_application")).alias("variant_id"), F.col("service_name_en").alias("label_en"), F.col("service_name_bn").alias("label_bn"), docs.alias("required_docs"), steps.alias("steps"))
    empty = (F.size("fees") == 0) & (F.size("required_docs") == 0) & (F.size(steps) == 0)
    return j.select(
        "doc_id", "category", "service_name_en", "service_name_bn", "office", none.alias("locality"),
        F.when(empty, F.array().cast("array<struct<variant_id:string,label_en:string,label_bn:string,required_docs:array<struct<doc:string,mandatory:boolean,source_url:string>>,steps:array<struct<step:string,where:string,source_url:string>>>>")).otherwise(F.array(variant)).alias("variants"),
        F.transform("fees", fee).alias("fees"), none.alias("office_location"), "contact", "apply_portal", F.col("url").alias("source_url"), day.alias("last_scraped_date"), F.when(~empty, F.col("updated")).alias("source_last_updated"),
        F.when(empty, unread(F.coalesce("why", F.lit("nothing could be read")))).otherwise(seen(F.lit("read by rule"))).alias("verification"),
        F.when(empty, F.array(F.concat(F.lit("not ingestible yet: "), F.coalesce("why", F.lit("nothing could be read"))))).otherwise(F.array().cast("array<string>")).alias("notes"),
    )

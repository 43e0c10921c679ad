"""Rows of an office's service table folded into records: what cannot be read stays, unverified, with its raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fees import parse_fees, split_docs

#: A row of nothing but brackets, digits, stops and blanks numbers the columns (fixed pattern).
COLUMN_NUMBERS = r"^[\(\)১-৯০-৯\s.।]*$"
FIELDS = ("service", "method", "docs", "fee", "time", "officer")


def title_of(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def fee_key(*parts: Column) -> Column:
    """Lower case, joined by underscores, other marks as underscores."""
    return F.regexp_replace(F.lower(F.concat_ws("_", *parts)), r"[^\p{L}\p{M}\p{Nd}]+", "_")


def cells(rows: DataFrame, columns: dict[str, int]) -> DataFrame:
    """rows (office_id, row_no, cells) by the column of each field; a short row has empty fields."""
    at = lambda f: F.coalesce(F.get("cells", F.lit(columns[f])), F.lit("")) if f in columns else F.lit("")
    return rows.select("office_id", "row_no", *(at(f).alias(f) for f in FIELDS))


def service_rows(named: DataFrame, classified: DataFrame, offices: DataFrame) -> DataFrame:
    """Rows of services that their office accepts.

    named: `cells`; classified (service, category); offices (office_id, office, charter_url, apply_portal,
    accept_categories, updated). Rows without a name and column numbers go, and so do unknown categories.
    """
    real = named.where((F.col("service") != "") & ~F.col("service").rlike(COLUMN_NUMBERS))
    j = real.join(classified.dropDuplicates(["service"]), "service").join(offices, "office_id")
    return j.where(~F.col("category").isin("unknown_service", "out_of_scope") & F.array_contains("accept_categories", F.col("category")))


def records(rows: DataFrame, today: Column, reader: str) -> DataFrame:
    """One record a category of `service_rows`, in the order of (office_id, row_no); variants and fees are arrays.

    A category's rows are those of a few offices' tables, so a record is small.
    """
    head = lambda c, n: F.left(c, F.lit(n))
    parsed = rows.withColumn("parsed", parse_fees(F.col("fee")))
    doc = lambda d: F.struct(d.alias("doc"), F.lit(True).alias("mandatory"), F.col("charter_url").alias("source_url"))
    step = lambda c: F.struct(c.alias("step"), F.col("office").alias("where"), F.col("charter_url").alias("source_url"))
    steps = F.filter(F.array(F.when(F.col("method") != "", step(head("method", 600))), F.when(F.col("time") != "", step(F.concat(F.lit("Stated service time: "), "time")))), lambda s: s.isNotNull())
    one = parsed.withColumn("variant", F.struct(head("service", 120).alias("label"), F.transform(split_docs(F.col("docs")), doc).alias("required_docs"), steps.alias("steps")))
    checked = lambda status, how: F.struct(F.lit(status).alias("status"), F.lit(reader if status == "source_read" else None).cast("string").alias("verified_by"), (today if status == "source_read" else F.lit(None)).cast("date").alias("verified_date"), how.alias("method"))
    shape = lambda key, label, amount, vat, check: F.struct(
        key.alias("part"), label.alias("label_bn"), head("service", 120).alias("label_en"), amount.cast("decimal(18,2)").alias("amount_bdt"), vat.alias("includes_vat"),
        F.col("charter_url").alias("source_url"), F.col("updated").alias("source_last_updated"), head("fee", 600).alias("raw_text"), check.alias("verification"),
    )
    read = F.transform("parsed.fees", lambda f, i: shape(i.cast("string"), f["label"], f["amount"], f["vat"], checked("source_read", f["method"])))
    unread = F.array(shape(F.lit("unparsed"), head("service", 120), F.lit(None), F.lit(None).cast("boolean"), checked("unverified", F.coalesce("parsed.note", F.lit("fee cell not parseable")))))
    one = one.withColumn("fee_rows", F.when(F.size("parsed.fees") > 0, read).otherwise(unread))
    line = F.struct("office_id", "row_no", "variant", "fee_rows", "service", "office", "officer", "apply_portal", "charter_url", "updated")
    folded = one.groupBy("category").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    first = F.col("lines")[0]
    keyed = F.flatten(F.transform("lines", lambda x, i: F.transform(x["fee_rows"], lambda f: f.withField("fee_key", F.concat(F.lit("row"), i.cast("string"), F.lit("_"), f["part"])).dropFields("part"))))
    return folded.select(
        "category", title_of(F.col("category")).alias("service_name_en"), F.left(first["service"], F.lit(120)).alias("service_name_bn"), first["office"].alias("office"),
        F.transform("lines", lambda x, i: x["variant"].withField("variant_id", F.concat(F.lit("charter_row_"), i.cast("string")))).alias("variants"), keyed.alias("fees"),
        F.nullif(F.left(first["officer"], F.lit(300)), F.lit("")).alias("contact"), first["apply_portal"].alias("apply_portal"), first["charter_url"].alias("source_url"),
        today.cast("date").alias("last_scraped_date"), first["updated"].alias("source_last_updated"),
    )

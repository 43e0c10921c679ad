"""The answer as ordered Markdown sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, number_set, to_bengali_digits


def amount_text(amount: Column, lang: Column) -> Column:
    """Null is not verified, zero is free; else the figure in the language's digits."""
    plain = F.format_number(amount, 0)
    return F.when(amount.isNull(), "NOT VERIFIED").when(amount == 0, "Free").when(lang == "bn", F.concat(to_bengali_digits(plain), F.lit(" / "), plain)).otherwise(plain)


def answers(matched: DataFrame) -> DataFrame:
    """matched (qid, lang, category, title, status, level, docs, fees(label, amount), source_url) -> qid, answer.

    No record: say so and stop. Unverified: warn, and print neither documents nor fees.
    """
    none, unverified = F.col("title").isNull(), F.coalesce(F.col("status") == "unverified", F.lit(False))
    open_ = ~none & ~unverified
    docs = F.when(open_ & (F.size("docs") > 0), F.concat(F.lit("### Documents\n"), F.array_join(F.transform("docs", lambda d: F.concat(F.lit("- "), d)), "\n")))
    fees = F.when(open_ & (F.size("fees") > 0), F.concat(F.lit("### Fees\n"), F.array_join(F.transform("fees", lambda f: F.concat(F.lit("| "), f["label"], F.lit(" | "), amount_text(f["amount"], F.col("lang")), F.lit(" |"))), "\n")))
    warning = F.when(~none & F.col("level").isin("stale", "unknown", "unverified"), F.concat(F.lit("> Source is "), F.col("level"), F.lit(".")))
    sections = F.array(
        F.when(none, F.lit("## No matching service")).otherwise(F.concat(F.lit("## "), F.col("title"))),
        warning, docs, fees, F.when(~none, F.concat(F.lit("Source: "), F.col("source_url"))),
    )
    return matched.select("qid", F.array_join(F.filter(sections, lambda s: s.isNotNull()), "\n\n").alias("answer"))


#: Words of the sections by language; a caller may give others.
WORDS = {
    "en": {"none": "No matching service", "warn": "Check before you go", "confirm": "Confirm at", "unread": "No verified details yet.", "where": "Check at", "contact": "Contact:", "documents": "Required documents",
           "missing": "Not available from a verified source", "steps": "Process", "fees": "Fees", "updated": "Updated", "unknown": "unknown", "scams": "Protect yourself", "source": "Source:", "dated": "Source last updated", "checked": "Checked", "apply": "Apply at"},
}
#: The same in Bengali, as readers of such answers know them (fixed values).
WORDS["bn"] = WORDS["en"] | {"documents": "প্রয়োজনীয় কাগজপত্র", "fees": "ফি", "dated": "উৎস সর্বশেষ হালনাগাদ"}


def age_note(age: Column, status: Column, days: int = 365) -> Column:
    """What a fee's age calls for; nothing for a fee without a date or of a fresh source."""
    return F.when(status == "unverified", "not verified").when(age > days, "more than a year old: likely out of date").when(age > 90, "older than the limit: confirm it")


def _lines(items: Column, shape) -> Column:
    return F.array_join(F.transform(items, shape), "\n")


def full_answers(matched: DataFrame, lang: str = "en", words: dict | None = None) -> DataFrame:
    """matched (qid, rationale, record, level, notes, patterns, lead) -> qid, answer, of the language's words.

    record: struct of records.RECORD or null; patterns: array<struct<claim, why, source, source_date, caveat>>; lead: an accepted
    generated answer or null. Order: no match and stop; title; warnings; unverified and stop; lead; documents; steps;
    fees; patterns; provenance. Where there is a lead, what follows is folded away beneath it.
    """
    w = words or WORDS[lang]
    r = F.col("record")
    none, unread = r.isNull(), F.coalesce(r["verification"]["status"] == "unverified", F.lit(False))
    after = ~none & ~unread
    docs = F.flatten(F.transform(r["variants"], lambda v: v["required_docs"]))
    steps = F.flatten(F.transform(r["variants"], lambda v: v["steps"]))
    label = (lambda f: filled(f["label_bn"], f["label_en"], f["fee_key"])) if lang == "bn" else (lambda f: filled(f["label_en"], f["label_bn"], f["fee_key"]))
    day = lambda d: F.coalesce(d.cast("string"), F.lit(w["unknown"]))
    head = lambda name: F.lit(f"### {w[name]}\n")
    fee = lambda f: F.concat(F.lit("| "), label(f), F.lit(" | "), amount_text(f["amount_bdt"], F.lit("bn")), F.lit(" | "), day(f["source_last_updated"]), F.lit(" |"))
    step = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["step"], F.coalesce(F.concat(F.lit(" — "), s["where"]), F.lit("")))
    scam = lambda p: F.concat(F.lit("- **"), p["claim"], F.lit("**"), F.coalesce(F.concat(F.lit(" "), p["why"]), F.lit("")), F.lit(" ("), p["source"], F.lit(", "), day(p["source_date"]), F.lit(")"), F.coalesce(F.concat(F.lit(" "), p["caveat"]), F.lit("")))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    contact = F.concat(F.lit(f"{w['contact']} "), r["contact"])
    origin = F.concat_ws("\n", F.concat(F.lit(f"---\n{w['source']} "), r["source_url"]), F.concat(F.lit(f"{w['dated']} "), day(r["source_last_updated"]), F.lit(f" · {w['checked']} "), day(r["last_scraped_date"])), F.concat(F.lit(f"{w['apply']} "), r["apply_portal"]), contact)
    sections = F.array(
        F.when(none, F.concat(F.lit(f"## {w['none']}\n"), F.coalesce("rationale", F.lit("")))),
        F.when(~none, F.concat_ws("\n", F.concat(F.lit("## "), r["service_name_bn"]), r["service_name_en"], r["office"])),
        F.when(~none & F.col("level").isin("stale", "unknown", "unverified"), F.concat_ws("\n", F.lit(f"> **{w['warn']}**"), F.nullif(_lines(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("> - "), n)), F.lit("")), F.concat(F.lit(f"> - {w['confirm']} "), r["source_url"]))),
        F.when(~none & unread, F.concat_ws("\n", F.lit(w["unread"]), F.nullif(_lines(F.slice(F.coalesce(r["notes"], F.array().cast("array<string>")), 1, 2), lambda n: F.concat(F.lit("- "), n)), F.lit("")), F.concat(F.lit(f"{w['where']} "), r["source_url"]), contact)),
        F.when(after & F.col("lead").isNotNull(), F.concat(F.col("lead"), F.lit("\n\n<details><summary>…</summary>"))),
        F.when(after, F.concat(head("documents"), F.when(some(docs), _lines(docs, lambda d: F.concat(F.lit("- "), d["doc"]))).otherwise(F.lit(f"_{w['missing']}_")))),
        F.when(after & some(steps), F.concat(head("steps"), _lines(steps, step))),
        F.when(after & some(r["fees"]), F.concat(head("fees"), F.lit(f"| {w['fees']} | BDT | {w['updated']} |\n|---|---|---|\n"), _lines(r["fees"], fee))),
        F.when(after & some(F.col("patterns")), F.concat(head("scams"), _lines(F.col("patterns"), scam))),
        F.when(after, origin),
        F.when(after & F.col("lead").isNotNull(), F.lit("</details>")),
    )
    return matched.select("qid", F.array_join(F.filter(sections, lambda s: s.isNotNull()), "\n\n").alias("answer"))


def facts(chunks: Column, record: Column, patterns: Column, most: int = 4, notes: Column | None = None) -> Column:
    """The lines that a text generator may draw on: what a record says, the first chunks, every pattern, warnings of its age.

    Of a record: names, office, portal, contact, date, every fee, document and step. A missing part has no line.
    """
    none = F.array().cast("array<string>")
    line = lambda mark, c: F.when(record.isNotNull() & filled(c).isNotNull(), F.concat(F.lit(f"{mark} "), c))
    each = lambda mark, c: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit(f"{mark} "), x))
    day = lambda d: F.coalesce(d.cast("string"), F.lit("unknown"))
    fee = lambda f: F.concat(F.lit("FEE "), filled(f["label_en"], f["label_bn"], f["fee_key"]), F.lit(": "), amount_text(f["amount_bdt"], F.lit("en")), F.lit(" (source of "), day(f["source_last_updated"]), F.lit(")"))
    inner = lambda part, field: F.transform(F.flatten(F.transform(record["variants"], lambda v: F.coalesce(v[part], F.array().cast(v_types[part])))), lambda x: x[field])
    v_types = {"required_docs": "array<struct<doc:string,mandatory:boolean,source_url:string>>", "steps": "array<struct<step:string,where:string,source_url:string>>"}
    numbered = F.transform(F.coalesce(inner("steps", "step"), none), lambda x, i: F.concat(F.lit("STEP "), (i + 1).cast("string"), F.lit(". "), x))
    head = F.array(
        F.when(record.isNotNull(), F.concat(F.lit("SERVICE "), F.concat_ws(" / ", record["service_name_bn"], record["service_name_en"]))), line("OFFICE", record["office"]), line("PORTAL", record["apply_portal"]),
        line("CONTACT", record["contact"]), F.when(record.isNotNull(), F.concat(F.lit("DATED "), day(record["source_last_updated"]))),
    )
    parts = F.concat(
        F.filter(head, lambda x: x.isNotNull()), F.coalesce(F.transform(record["fees"], fee), none), each("DOCUMENT", inner("required_docs", "doc")), numbered,
        each("CHUNK", F.slice(F.coalesce(chunks, none), 1, most)), F.coalesce(F.transform(patterns, lambda p: F.concat(F.lit("WARNING "), p["claim"])), none), each("NOTE", F.lit(None).cast("array<string>") if notes is None else notes),
        F.when(record.isNull(), none).otherwise(F.array(F.concat(F.lit("SOURCE "), record["source_url"]))),
    )
    return F.array_join(parts, "\n")


def accepted(generated: Column, facts_block: Column, question: Column | None = None) -> Column:
    """A generated text if every number in it stands in the facts or in the question; else null, and the template answers alone."""
    known = F.array_union(number_set(F.coalesce(facts_block, F.lit(""))), F.array(F.lit(""), F.lit("0")))
    if question is not None:
        known = F.array_union(known, number_set(F.coalesce(question, F.lit(""))))
    return F.when(F.size(F.array_except(number_set(generated), known)) == 0, generated)


def unfolded(markdown: Column) -> Column:
    """Struct (before, summary, inside, after) of the first <details> part; without one all is `before`."""
    p = r"(?s)^(.*?)<details><summary>(.*?)</summary>(.*?)</details>(.*)$"
    hit = markdown.rlike(p)
    part = lambda i: F.when(hit, F.trim(F.regexp_extract(markdown, p, i)))
    return F.struct(F.coalesce(part(1), markdown).alias("before"), part(2).alias("summary"), part(3).alias("inside"), part(4).alias("after"))

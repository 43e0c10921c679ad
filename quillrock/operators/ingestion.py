"""The ingestion agent for all categories at once: a frontier of actions, one round a tool, no driver loop.

The plan of a category is a queue: look for links on its seed pages, read the tables of the best of them, follow the rows
that name the service or a fee to a document, tell its encoding, decode it, read fees from its lines, draft or give up.
Actions go to the end of the queue, but for a decoding, which comes at once after what led to it. So the order of
all actions is known from what led to them, and each round is one job for every category and page, whose frontier is a written table. What a
category has done before it does not do again, and only its first `most` actions count: their number is a column, and an
action beyond it had no result. Fees are only ever those of the conservative reader, and a draft is never verified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fonts
from ..functions.fees import parse_fees
from ..session import shared_folder
from . import html

#: Labels worth more, labels to leave, words of fees, and what lines are asked for, first and then (fixed values).
GOOD = r"চার্টার|প্রতিশ্রুতি|বিধিমালা|আইন|গেজেট|ফি|প্রজ্ঞাপন|পরিপত্র|নির্দেশিকা|charter|fee|rule"
BAD = r"নিয়োগ|বদলি|পদোন্নতি|কর্মচারী|বাজেট|প্রশিক্ষণ|recruit|transfer|training"
FEE_WORDS = r"হার|ফি|টাকা|মূল্য|চার্জ"
LINES = ("টাকা", "হার")
STEPS, BOOST, FOLLOWED, PARSED, SHOWN = 15, 10, 6, 6, 25
AUDIENCE = "Reached from the office's own public pages; a person must confirm that it is written for citizens."


@dataclass
class Rules:
    good: str = GOOD
    bad: str = BAD
    fee_words: str = FEE_WORDS
    lines: tuple[str, str] = LINES
    keywords: tuple = html.KEYWORDS
    suffix: str = ".gov.bd"


def _first(df: DataFrame, order: list) -> DataFrame:
    """Of a category's equal actions (arg) the first by `order`."""
    w = Window.partitionBy("category", "arg").orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _seeds(categories: DataFrame) -> DataFrame:
    one = categories.select("category", F.posexplode("seeds").alias("k1", "arg")).where("arg is not null")
    return _first(one, ["k1"])


def _candidates(seeds: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """(category, k1, k2, arg): the best links of each seed page, labels weighed."""
    asked = pages.join(seeds.select(F.col("arg").alias("url")).distinct(), "url", "left_semi")
    found = html.links(asked).withColumn("target", html.resolve(F.col("url"), F.col("href")))
    found = html.followed(found, rules.suffix).withColumn("score", html.keyword_score(F.lower(F.concat_ws(" ", "label", "target")), F.col("target"), rules.keywords))
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", "label", "target")), asc=False), 1, SHOWN)
    shown = html.best_links(found).groupBy("url").agg(best.alias("l"))
    kept = F.filter("l", lambda x: ~F.left(x["label"], F.lit(70)).rlike(rules.bad))
    weighed = F.transform(kept, lambda x: F.struct((x["score"] + F.when(F.left(x["label"], F.lit(70)).rlike(rules.good), BOOST).otherwise(0)).alias("score"), x["target"].alias("target")))
    top = shown.select("url", F.slice(F.sort_array(weighed, asc=False), 1, FOLLOWED).alias("l"))
    j = seeds.select("category", "k1", F.col("arg").alias("url")).join(top, "url")
    return _first(j.select("category", "k1", F.posexplode("l").alias("k2", "x")).select("category", "k1", "k2", F.col("x.target").alias("arg")), ["k1", "k2"])


def _documents(candidates: DataFrame, categories: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """(category, k1, k2, k3, arg): of each row that names the service or a fee, the first link to a PDF."""
    asked = pages.join(candidates.select(F.col("arg").alias("url")).distinct(), "url", "left_semi")
    rows = asked.select("url", F.flatten(html.table_preview(F.col("html"), chars=80)).alias("rows"))
    linked = lambda r: F.filter(F.slice(F.transform(r["links"], lambda x: html.resolve(F.col("url"), x)), 1, 2), lambda x: F.lower(x).endswith(".pdf"))
    slim = rows.select("url", F.posexplode(F.transform("rows", lambda r: F.struct(F.concat_ws(" ", r["cells"]).alias("text"), F.get(linked(r), F.lit(0)).alias("to")))).alias("k3", "r")).where("r.to is not null")
    j = candidates.withColumnRenamed("arg", "url").join(slim, "url").join(categories.select("category", "terms"), "category")
    named = F.exists("terms", lambda t: (t != "") & F.contains(F.col("r.text"), t)) | F.col("r.text").rlike(rules.fee_words)
    return _first(j.where(F.coalesce(named, F.lit(False))).select("category", "k1", "k2", "k3", F.col("r.to").alias("arg")), ["k1", "k2", "k3"])


def _decoded(found: DataFrame, bodies: DataFrame, table: dict[str, str], rules: Rules) -> DataFrame:
    """(url, encoding, n_lines, lines1, lines2): each document once, however many categories it was found for."""
    asked = bodies.join(found.select(F.col("arg").alias("url")).distinct(), "url", "left_semi")
    read = fonts.routed(asked, table, "text", "is_pdf", "corrected")
    lines = F.filter(F.transform(F.split(F.coalesce("decoded", F.lit("")), "\n"), F.trim), lambda x: x != "")
    read = read.select("url", "encoding", lines.alias("l"))
    has = lambda word: F.filter("l", lambda x: F.contains(x, F.lit(word)))
    return read.select("url", "encoding", F.size("l").alias("n_lines"), has(rules.lines[0]).alias("lines1"), has(rules.lines[1]).alias("lines2"))


def actions(categories: DataFrame, pages: DataFrame, bodies: DataFrame, table: dict[str, str] | None = None, rules: Rules | None = None, most: int = STEPS) -> DataFrame:
    """The trace of every category: (category, step, tool, arg, ok, result struct<url, fees>), steps from 1 to `most` at most.

    categories (category, terms array, seeds array), pages (url, html) and bodies (url, text, is_pdf, corrected) by distinct
    addresses: what a fetch would give.
    """
    rules, spark = rules or Rules(), categories.sparkSession
    folder = shared_folder(spark, "ingestion")

    def kept(df: DataFrame, name: str) -> DataFrame:
        """The frontier of a round, written: the next one and the trace read it."""
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    seeds = kept(_seeds(categories), "seeds")
    candidates = kept(_candidates(seeds, pages, rules), "candidates")
    found = kept(_documents(candidates, categories, pages, rules), "documents")
    read = kept(_decoded(found, bodies, table or {}, rules), "read")
    there = pages.select(F.col("url").alias("arg"), F.lit(True).alias("there"))
    none, zero = F.lit(None).cast("array<struct<amount:bigint,label:string,vat:boolean,method:string>>"), F.lit(0)

    def action(df, stage, tool, k, ok, url=None, fees=None):
        keys = [F.col(x).cast("int") if isinstance(x, str) else x for x in k] + [zero] * (6 - len(k))
        own = [F.lit(stage).alias("stage"), *(x.alias(f"o{i}") for i, x in enumerate(keys)), F.lit(tool).alias("tool"), "arg", F.coalesce(ok, F.lit(False)).alias("ok")]
        return df.select("category", *own, (F.lit(None).cast("string") if url is None else url).alias("url"), (none if fees is None else fees).alias("fees"))

    one = action(seeds.join(there, "arg", "left"), 0, "discover_links", ["k1"], F.col("there"))
    two = action(candidates.join(there, "arg", "left"), 1, "extract_tables", ["k1", "k2"], F.col("there"))
    with_body = found.join(read.withColumnRenamed("url", "arg"), "arg", "left")
    place = ["k1", "k2", "k3"]
    three = action(with_body, 2, "detect", [*place, zero], F.col("encoding").isNotNull())
    readable = with_body.where(fonts.readable(F.col("encoding")))
    hit = F.when(F.size("lines1") > 0, F.col("arg"))
    four = action(readable, 2, "decode", [*place, F.lit(1)], F.col("n_lines") > 0, hit)
    again = readable.where("size(lines1) = 0 and n_lines > 0")
    five = action(again, 2, "decode_wider", [*place, F.lit(2)], F.lit(True), F.when(F.size("lines2") > 0, F.col("arg")))
    lines = F.when(F.size("lines1") > 0, F.col("lines1")).otherwise(F.col("lines2"))
    cells = readable.select("category", *place, F.posexplode(F.slice(lines, 1, PARSED)).alias("k4", "arg"))
    cells = _first(cells, [*place, "k4"]).withColumn("p", parse_fees(F.col("arg"))["fees"])
    six = action(cells, 3, "parse_fee", [*place, "k4"], F.lit(True), None, F.filter("p", lambda f: f["amount"].isNotNull()))
    every = one
    for more in (two, three, four, five, six):
        every = every.unionByName(more)
    order = Window.partitionBy("category").orderBy("stage", *(f"o{i}" for i in range(6)))
    numbered = every.withColumn("step", F.row_number().over(order)).where(F.col("step") <= most)
    return numbered.select("category", "step", "tool", "arg", "ok", "url", "fees")


def outcomes(categories: DataFrame, trace: DataFrame, most: int = STEPS) -> DataFrame:
    """(category, outcome, step, source_url, fees array<struct<fee_key, label, amount, vat, raw_text>>, audience_check) of every category.

    outcome: 'save_draft' if a document was decoded and a fee read, else 'give_up', each one more step; 'budget' where the steps
    ran out before. Fees count in the order of their steps; the source is the last document with lines.
    """
    mine = F.array_sort(F.collect_list(F.when(F.size("fees") > 0, F.struct("step", F.transform("fees", lambda f: F.struct(f["label"], f["amount"], f["vat"], F.col("arg").alias("raw_text"))).alias("fees")))))
    got = trace.groupBy("category").agg(F.max("step").alias("n"), F.max_by("url", F.when(F.col("url").isNotNull(), F.col("step"))).alias("source_url"), mine.alias("f"))
    flat = F.flatten(F.transform("f", lambda x: x["fees"]))
    keyed = F.transform(flat, lambda f, i: F.struct(F.concat(F.lit("agent_"), F.lpad(i.cast("string"), 2, "0")).alias("fee_key"), F.left(f["label"], F.lit(180)).alias("label"), f["amount"].alias("amount"), f["vat"].alias("vat"), F.left(f["raw_text"], F.lit(400)).alias("raw_text")))
    j = categories.select("category").join(got.withColumn("fees", keyed), "category", "left")
    n = F.coalesce("n", F.lit(0))
    outcome = F.when(n >= most, "budget").when(F.col("source_url").isNotNull() & (F.size("fees") > 0), "save_draft").otherwise("give_up")
    return j.select("category", outcome.alias("outcome"), F.when(outcome != "budget", n + 1).alias("step"), "source_url", F.coalesce("fees", F.array().cast(got.withColumn("fees", keyed).schema["fees"].dataType)).alias("fees"), F.when(outcome == "save_draft", AUDIENCE).alias("audience_check"))


def as_drafts(found: DataFrame) -> DataFrame:
    """What sinks.drafts takes: the drafts among the outcomes."""
    return found.where("outcome = 'save_draft'").select("category", "source_url", "fees", "audience_check")


def tombstones(found: DataFrame, at: Column) -> DataFrame:
    """What sinks.write_not_found takes: categories without a source."""
    why = F.concat(F.lit("took "), (F.col("step") - 1).cast("string"), F.lit(" actions; "), F.when(F.col("source_url").isNull(), "no readable document").otherwise("no fee could be read"))
    return found.where("outcome = 'give_up'").select("category", why.alias("reason"), at.alias("at"))

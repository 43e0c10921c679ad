"""Queries of answers, evaluation, records, offices, pages, fonts and agents over the shared tables, with their SQL.

Stand-ins: suppliers make records (one fee each, its figure from the balance), customers the rows of offices' tables,
documents the texts of answers, events an attempt log. Each operator reads what the query builds; the SQL says the
outcome from the table's own columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embed, fonts
from ..functions.text import nfc
from ..operators import agent, classify, compose, evaluate, html, offices, records
from .catalogue import LINK_SQL, NUMS, PAGE_SCORE, PAGE_WORDS, VISIBLE, _links  # noqa: F401
from .registry import query, table

TODAY = "2024-06-30"

# ---- classification --------------------------------------------------------------------------------


@query("""WITH p AS (SELECT label AS pid, i, round(avg(x), 5) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, i),
e AS (SELECT vec_id AS qid, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT qid, CAST(pid AS VARCHAR) AS pid, round(sum(x * m), 6) AS score FROM e JOIN p USING (i) GROUP BY qid, pid),
h AS (SELECT vec_id AS qid, CAST(label AS VARCHAR) AS category FROM embeddings WHERE vec_id % 3 = 0 UNION SELECT vec_id, CAST((label + 1) % 10 AS VARCHAR) FROM embeddings WHERE vec_id % 6 = 0),
n AS (SELECT qid, count(*) AS n, min(category) AS only_one FROM h GROUP BY qid),
c AS (SELECT s.*, coalesce(n, 0) AS n, only_one FROM s LEFT JOIN n USING (qid) WHERE n IS NULL OR n = 1 OR EXISTS (SELECT 1 FROM h WHERE h.qid = s.qid AND h.category = s.pid)),
r AS (SELECT qid, pid, score, n, only_one, round(score - lead(score) OVER w, 6) AS gap, row_number() OVER w AS r FROM c WINDOW w AS (PARTITION BY qid ORDER BY score DESC, pid))
SELECT qid, CASE WHEN n = 1 THEN only_one WHEN n > 1 OR (score >= 0.2 AND coalesce(gap >= 0.015, true)) THEN pid ELSE 'unknown_service' END AS category,
CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE score END AS confidence, CASE WHEN n = 1 THEN 'alias' WHEN n > 1 THEN 'alias+embedding' ELSE 'embedding' END AS method FROM r WHERE r = 1""")
def classify_resolved(spark, sf_dir):
    """One alias hit decides, several are told apart by their profiles, none leaves it to all profiles."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("m"))
    profiles = parts.groupBy(F.col("label").cast("string").alias("category")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("pvec"))
    hit = lambda of, label: e.where(F.col("vec_id") % of == 0).select(F.col("vec_id").alias("qid"), label.cast("string").alias("category"), F.lit("x").alias("alias"))
    hits = hit(3, F.col("label")).unionByName(hit(6, (F.col("label") + 1) % 10)).distinct()
    return classify.resolve(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), hits, profiles, floor=0.2).select("qid", "category", "confidence", "method")


@query("SELECT lang AS category, count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'fr') GROUP BY 1")
def fallback_short_cut(spark, sf_dir):
    """What goes on to retrieval when two languages stand for the fallback categories."""
    on, _ = classify.answerable(table(spark, sf_dir, "documents").select(F.col("lang").alias("category")), ("en", "fr"))
    return on.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND lang NOT IN (SELECT DISTINCT lang FROM documents WHERE doc_id % 2 = 0 AND lang <> 'de' AND lang IS NOT NULL)")
def classifier_contract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return classify.outside(d.where("lang is not null").select("doc_id", F.col("lang").alias("category")), d.where("doc_id % 2 = 0 and lang <> 'de'").select(F.col("lang").alias("id")).distinct()).select("doc_id")


# ---- evaluation ------------------------------------------------------------------------------------

# Marks of answers (fixed values).
FREE, UNREAD, DATED = ["free", "বিনামূল্যে"], ["not verified"], ["Source last updated"]


def _answers(spark, sf_dir):
    """(doc_id, md, status, url, amounts, docs): an answer from each document, and the record it should rest on."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.regexp_replace(F.left("text", F.lit(70)), "[\\n|]", " ").alias("head"))
    i = F.col("doc_id")
    body = F.concat(F.lit("### Documents\n- x"), i.cast("string"), F.lit(" form\n- y"), "head", F.lit("\n- _none_\n### Fees\n| Service | Fee (BDT) | Date |\n|---|---|---|\n| A | "), F.format_number("n_chars", 0), F.lit(" | d |\n| B | free | d |\n| C | not verified | d |\n---\nsrc "), F.when(i % 5 == 0, "none").otherwise(F.concat(F.lit("u"), i.cast("string"))), F.when(i % 7 == 0, "").otherwise(" Source last updated"))
    known = F.when(i % 2 == 0, F.array(F.col("n_chars").cast("long"), F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    docs = F.when(i % 3 == 0, F.array(F.concat(F.lit("x"), i.cast("string")), F.concat(F.lit("y"), "head", F.lit(" more")))).otherwise(F.array(F.concat(F.lit("x"), i.cast("string"))))
    status = F.when(i % 11 == 0, F.lit(None).cast("string")).when(i % 4 == 0, "unverified").otherwise("source_read")
    return d.select("doc_id", "lang", body.alias("md"), status.alias("status"), F.concat(F.lit("u"), i.cast("string")).alias("url"), known.alias("amounts"), docs.alias("docs"), "head")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR n_chars = 0 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS problems FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL")
def eval_grounding_amounts(spark, sf_dir):
    a = _answers(spark, sf_dir).where("md is not null")
    printed = evaluate.table_amounts(evaluate.section(F.col("md"), "Fees"), "Fee (BDT)", FREE, UNREAD)
    return a.select("doc_id", F.array_join(evaluate.ungrounded_amounts(printed, F.col("amounts")).cast("array<string>"), ",").alias("problems"))


@query("""WITH d AS (SELECT doc_id, trim('y' || regexp_replace(left(text, 70), '[\\n|]', ' ', 'g')) AS item FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 OR contains(item, 'x' || doc_id) THEN 0 ELSE 1 END AS BIGINT) AS n_ungrounded FROM d""")
def eval_grounding_documents(spark, sf_dir):
    a = _answers(spark, sf_dir).where("md is not null")
    printed = evaluate.bullets(evaluate.section(F.col("md"), "Documents"))
    return a.select("doc_id", F.size(evaluate.ungrounded_documents(printed, F.col("docs"))).cast("long").alias("n_ungrounded"))


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'fees_without_record' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 4 = 0 THEN 'fees_unverified' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 4 = 0 THEN 'documents_unverified' END,
CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 = 0 AND NOT contains(left(text, 70), 'u' || doc_id) THEN 'source_missing' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 = 0 THEN 'date_missing' END], lambda x: x IS NOT NULL)) AS problem FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL""")
def eval_safety(spark, sf_dir):
    a = _answers(spark, sf_dir).where("md is not null")
    return a.select("doc_id", F.explode(evaluate.safety_problems(F.col("md"), F.col("status"), F.col("url"), "Fees", "Documents", DATED)).alias("problem"))


@query("""WITH t AS (SELECT doc_id, lower(nfc_normalize(coalesce(text, ''))) AS t FROM documents)
SELECT doc_id, array_to_string(list_concat(list_transform(list_filter(['THE', 'Tion'], lambda w: NOT contains(t, lower(w))), lambda w: 'missing:' || w), list_transform(list_filter(['que', 'ung'], lambda w: contains(t, w)), lambda w: 'forbidden:' || w)), ',') AS problems FROM t""")
def eval_assertions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", nfc(F.coalesce("text", F.lit(""))).alias("text"))
    wanted, never = F.array(F.lit("THE"), F.lit("Tion")), F.array(F.lit("que"), F.lit("ung"))
    return d.select("doc_id", F.array_join(evaluate.assertion_problems(F.col("text"), wanted, never), ",").alias("problems"))


@query("""WITH q AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents WHERE doc_id % 9 <> 0),
r AS (SELECT d.lang AS kind, coalesce(q.lang = CASE WHEN d.doc_id % 4 = 0 THEN 'en' ELSE d.lang END, false) AS i, coalesce(contains(lower(nfc_normalize(q.t)), 'the'), false) AS a, coalesce(q.doc_id % 2 = 0, false) AS g, coalesce(q.doc_id % 5 <> 0, false) AS s FROM documents d LEFT JOIN q USING (doc_id))
SELECT kind, count(*) AS n, count(*) FILTER (i) AS n_intent, count(*) FILTER (a) AS n_assert, count(*) FILTER (g) AS n_ground, count(*) FILTER (s) AS n_safe, round(count(*) FILTER (i) / count(*), 4) AS intent_rate, round(count(*) FILTER (a) / count(*), 4) AS assert_rate,
round(count(*) FILTER (g) / count(*), 4) AS ground_rate, round(count(*) FILTER (s) / count(*), 4) AS safe_rate, round(1 - count(*) FILTER (g) / count(*), 4) AS hallucination_rate FROM r GROUP BY kind""")
def eval_report(spark, sf_dir):
    """Questions joined with answers; every ninth has none, and fails."""
    d = table(spark, sf_dir, "documents").dropDuplicates(["doc_id"]).withColumn("plain", nfc(F.coalesce("text", F.lit(""))))
    i, some = F.col("doc_id"), lambda bad, name: F.filter(F.array(F.when(bad, name)), lambda x: x.isNotNull())
    questions = d.select(i.alias("id"), F.col("lang").alias("kind"), F.when(i % 4 == 0, "en").otherwise(F.col("lang")).alias("expect_category"))
    asserted = evaluate.assertion_problems(F.col("plain"), F.array(F.lit("the")), F.lit(None).cast("array<string>"))
    answered = d.where("doc_id % 9 <> 0").select(i.alias("id"), F.col("lang").alias("category"), asserted.alias("asserted"), some(i % 2 != 0, "amount").alias("grounded"), some(i % 5 == 0, "date_missing").alias("safe"))
    return evaluate.scores(evaluate.judged(questions, answered), "kind")


# ---- records ---------------------------------------------------------------------------------------

AMOUNT_SQL = "CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS BIGINT) END"


def supplier_records(spark, sf_dir):
    """A record a supplier: one fee with the balance as its figure, one variant of one document and one step."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    text = k.cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))
    check = F.struct(F.when(k % 3 == 0, "unverified").otherwise("source_read").alias("status"), F.lit(None).cast("string").alias("verified_by"), F.lit(None).cast("date").alias("verified_date"), F.lit("read").alias("method"))
    amount = F.when(b > 0, F.floor(b)).cast("decimal(18,2)")
    fee = F.struct(
        F.lit("f0").alias("fee_key"), F.when(k % 2 == 0, F.col("s_name")).alias("label_en"), F.lit("").alias("label_bn"), amount.alias("amount_bdt"), F.lit(None).cast("boolean").alias("includes_vat"), F.when(k % 4 != 0, F.concat(F.lit("http://fee/"), (k % 10).cast("string"))).alias("source_url"),
        F.lit(None).cast("string").alias("source_document"), day.alias("source_last_updated"), F.lit("raw").alias("raw_text"), check.alias("verification"),
    )
    variant = F.struct(F.lit("v").alias("variant_id"), F.lit("V").alias("label_en"), F.lit("V").alias("label_bn"), F.array(F.struct(F.concat(F.lit("Form "), text).alias("doc"), F.lit(True).alias("mandatory"), F.lit("http://x").alias("source_url"))).alias("required_docs"), F.array(F.struct(F.lit("Apply").alias("step"), F.lit("Desk").alias("where"), F.lit("http://x").alias("source_url"))).alias("steps"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), text).alias("category"), F.concat(F.lit("Service "), text).alias("service_name_en"), F.col("s_name").alias("service_name_bn"), F.lit("Office").alias("office"), F.lit(None).cast("string").alias("locality"),
        F.array(variant).alias("variants"), F.array(fee).alias("fees"), F.lit(None).cast("string").alias("office_location"), F.when(k % 7 == 0, "Desk 1").alias("contact"), F.lit(None).cast("string").alias("apply_portal"), F.concat(F.lit("http://rec/"), (k % 6).cast("string")).alias("source_url"),
        F.lit(TODAY).cast("date").alias("last_scraped_date"), F.when(k % 8 != 0, day).alias("source_last_updated"), check.alias("verification"), F.array(F.when(k % 13 == 0, "never pay a Broker").otherwise("fine")).alias("notes"),
    )


@query(f"""WITH s AS (SELECT 's' || s_suppkey AS category, s_suppkey AS k, {AMOUNT_SQL} AS a FROM supplier)
SELECT category, 'unknown_category' AS rule FROM s WHERE k % 5 = 0 UNION ALL SELECT category, 'amount_without_verification' FROM s WHERE a IS NOT NULL AND k % 3 = 0
UNION ALL SELECT category, 'verified_without_amount' FROM s WHERE a IS NULL AND k % 3 <> 0 UNION ALL SELECT category, 'fee_without_source' FROM s WHERE a IS NOT NULL AND k % 4 = 0""")
def record_violations(spark, sf_dir):
    r = supplier_records(spark, sf_dir)
    valid = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return records.violations(r, valid)


RECORD_AGE = f"date_diff('day', DATE '2024-01-01' + CAST(s_suppkey % 300 AS INTEGER), DATE '{TODAY}')"
WARNED = f"""SELECT 's' || s_suppkey AS category, 'undated_record' AS rule FROM supplier WHERE s_suppkey % 8 = 0 AND s_suppkey % 3 <> 0
UNION ALL SELECT 's' || s_suppkey, 'old_record' FROM supplier WHERE s_suppkey % 8 <> 0 AND {RECORD_AGE} > 90
UNION ALL SELECT 's' || s_suppkey, 'old_fee' FROM supplier WHERE s_acctbal > 0 AND {RECORD_AGE} > 90"""


@query(WARNED)
def record_warnings(spark, sf_dir):
    return records.warnings(supplier_records(spark, sf_dir), F.lit(TODAY).cast("date"))


@query("SELECT 's' || s_suppkey AS category, 'scam_text:broker' AS rule FROM supplier WHERE s_suppkey % 13 = 0")
def record_scam_texts(spark, sf_dir):
    return records.scam_texts(supplier_records(spark, sf_dir), ("broker", "middleman"), "anti-broker fact")


@query(f"SELECT 'error' AS severity, count(*) AS n FROM supplier WHERE s_suppkey % 13 = 0 UNION ALL SELECT 'warning', count(*) FROM ({WARNED})")
def record_severities(spark, sf_dir):
    r = supplier_records(spark, sf_dir)
    return records.severities(records.scam_texts(r, ("broker",), "anti-broker fact"), records.warnings(r, F.lit(TODAY).cast("date")))


@query("SELECT 's' || s_suppkey AS category, CAST(1 AS BIGINT) AS n_fees, CAST(s_acctbal > 0 AS BIGINT) AS n_amounts, CAST(s_suppkey % 3 <> 0 AS BIGINT) AS n_verified, CAST(1 AS BIGINT) AS n_docs FROM supplier")
def record_counts(spark, sf_dir):
    return records.counts(supplier_records(spark, sf_dir))


@query("""WITH u AS (SELECT DISTINCT 'http://rec/' || s_suppkey % 6 AS url, 's' || s_suppkey AS category FROM supplier UNION SELECT 'http://fee/' || s_suppkey % 10, 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT url, string_agg(category, ',' ORDER BY category) AS categories FROM u GROUP BY url""")
def record_urls_in_use(spark, sf_dir):
    return records.urls_in_use(supplier_records(spark, sf_dir)).select("url", F.array_join("categories", ",").alias("categories"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id FROM region UNION SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey > 20")
def valid_categories(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"))
    return records.valid_categories(r, table(spark, sf_dir, "nation").where("n_nationkey > 20").select(F.col("n_nationkey").cast("string").alias("id")))


@query("SELECT count(*) FILTER (c_nationkey = 1) AS n FROM customer HAVING count(*) FILTER (c_nationkey = 1) <> 5")
def taxonomy_priority_gap(spark, sf_dir):
    return records.priority_gap(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mvp_priority")))


@query("""WITH a AS (SELECT 'n' || n_nationkey AS url, n_nationkey % 3 <> 0 AS reachable, n_nationkey % 5 = 0 AS js FROM nation WHERE n_nationkey < 20), c AS (SELECT c_custkey AS k, 'c' || c_custkey AS id, 'n' || c_nationkey AS url FROM customer),
j AS (SELECT id, CASE WHEN reachable IS NULL THEN 'not_audited' WHEN NOT reachable THEN 'not_reachable' WHEN js THEN 'js_shell' END AS rule FROM c LEFT JOIN a USING (url) WHERE k % 4 <> 0)
SELECT id, CASE WHEN rule = 'js_shell' THEN 'warning' ELSE 'error' END AS severity, rule FROM j WHERE rule IS NOT NULL UNION ALL SELECT id, 'error', 'no_sources' FROM c WHERE k % 8 = 0 UNION ALL SELECT id, 'warning', 'unmapped' FROM c WHERE k % 4 = 0""")
def taxonomy_sources(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 4 != 0, F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))).otherwise(F.array().cast("array<string>")).alias("sources"), F.when(k % 8 == 0, "t1").otherwise("unmapped").alias("ingest_tier"))
    n = F.col("n_nationkey")
    audited = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), n.cast("string")).alias("url"), (n % 3 != 0).alias("reachable"), (n % 5 == 0).alias("likely_js"))
    return records.taxonomy_problems(c, audited)


@query("""WITH r AS (SELECT c_nationkey AS o, c_custkey AS k, lower(c_mktsegment) || '_desk' AS category FROM customer WHERE c_custkey % 10 <> 9 AND c_mktsegment <> 'BUILDING' AND NOT (c_nationkey % 2 = 0 AND c_mktsegment = 'MACHINERY')),
n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY o, k) - 1 AS i FROM r)
SELECT category, upper(category[1]) || substr(replace(category, '_d', ' D'), 2) AS service_name_en, count(*) AS n_variants, CAST(sum(CASE WHEN k % 3 = 0 THEN k END) AS BIGINT) AS total, count(*) FILTER (k % 3 <> 0) AS n_unread,
string_agg('row' || i || CASE WHEN k % 3 = 0 THEN '_0' ELSE '_unparsed' END, ',' ORDER BY i) AS keys, CAST(count(*) FILTER (k % 4 = 0) AS BIGINT) AS n_steps FROM n GROUP BY category""")
def records_from_offices(spark, sf_dir):
    """Customers as rows of their nation's table: every tenth numbers the columns, two thirds of the fees can't be read."""
    k = F.col("c_custkey")
    cells = F.array(F.when(k % 10 == 9, "(১)").otherwise(F.col("c_mktsegment")), F.when(k % 4 == 0, "By post").otherwise(""), F.lit(""), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("/- টাকা"))).when(k % 3 == 1, "").otherwise("দরপত্র"))
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_nationkey").alias("office_id"), k.alias("row_no"), cells.alias("cells"))
    rows = rows.unionByName(table(spark, sf_dir, "customer").where("c_custkey = 0").select(F.col("c_nationkey").alias("office_id"), k.alias("row_no"), cells.alias("cells")))
    named = offices.cells(rows, {"service": 0, "method": 1, "docs": 2, "fee": 3})
    classified = named.select("service").distinct().withColumn("category", F.when(F.col("service") == "BUILDING", "unknown_service").otherwise(F.concat(F.lower("service"), F.lit("_desk"))))
    accept = F.transform(F.array(*(F.lit(x) for x in ("automobile", "furniture", "household"))), lambda x: F.concat(x, F.lit("_desk")))
    n = F.col("n_nationkey")
    office = table(spark, sf_dir, "nation").select(n.alias("office_id"), F.col("n_name").alias("office"), F.concat(F.lit("http://n/"), n.cast("string")).alias("charter_url"), F.lit(None).cast("string").alias("apply_portal"), F.when(n % 2 == 0, accept).otherwise(F.concat(accept, F.array(F.lit("machinery_desk")))).alias("accept_categories"), F.lit(TODAY).cast("date").alias("updated"))
    r = offices.records(offices.service_rows(named, classified, office), F.lit(TODAY), "reader")
    amounts = F.transform("fees", lambda f: f["amount_bdt"].cast("long"))
    return r.select(
        "category", "service_name_en", F.size("variants").cast("long").alias("n_variants"), F.aggregate(amounts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("total"), F.size(F.filter("fees", lambda f: f["verification"]["status"] == "unverified")).cast("long").alias("n_unread"),
        F.array_join(F.transform("fees", lambda f: f["fee_key"]), ",").alias("keys"), F.size(F.flatten(F.transform("variants", lambda v: v["steps"]))).cast("long").alias("n_steps"),
    )


@query("SELECT c_custkey, regexp_replace(lower(c_mktsegment || '_' || c_name), '[^a-z0-9]+', '_', 'g') AS fee_key FROM customer")
def fee_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", offices.fee_key(F.col("c_mktsegment"), F.col("c_name")).alias("fee_key"))


# ---- answers ---------------------------------------------------------------------------------------

BN = "translate(format('{:,}', CAST(floor(s_acctbal) AS BIGINT)), '0123456789', '০১২৩৪৫৬৭৮৯')"
DAY = "CAST(DATE '2024-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS VARCHAR)"


@query(f"""SELECT s_suppkey AS qid, replace(CASE WHEN s_suppkey % 17 = 0 THEN '## No matching service~no hit' ELSE array_to_string(list_filter(['## ' || s_name || '~Service ' || s_suppkey || '~Office',
CASE WHEN s_suppkey % 5 = 0 THEN '> **Check before you go**~> - old~> - Confirm at http://rec/' || s_suppkey % 6 END,
CASE WHEN s_suppkey % 3 = 0 THEN 'No verified details yet.~- ' || CASE WHEN s_suppkey % 13 = 0 THEN 'never pay a Broker' ELSE 'fine' END || '~Check at http://rec/' || s_suppkey % 6 || CASE WHEN s_suppkey % 7 = 0 THEN '~Contact: Desk 1' ELSE '' END
ELSE '### Required documents~- Form ' || s_suppkey || '~~### Process~1. Apply — Desk~~### Fees~| Fees | BDT | Updated |~|---|---|---|~| ' || CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'f0' END || ' | ' || CASE WHEN s_acctbal <= 0 THEN 'NOT VERIFIED' WHEN floor(s_acctbal) = 0 THEN 'Free' ELSE {BN} || ' / ' || format('{{:,}}', CAST(floor(s_acctbal) AS BIGINT)) END
|| ' | ' || {DAY} || ' |~~### Protect yourself~- **Pay at the desk** (gazette, 2020-01-01)~~---~Source: http://rec/' || s_suppkey % 6 || '~Source last updated ' || CASE WHEN s_suppkey % 8 = 0 THEN 'unknown' ELSE {DAY} END || ' · Checked {TODAY}' || CASE WHEN s_suppkey % 7 = 0 THEN '~Contact: Desk 1' ELSE '' END END], lambda x: x IS NOT NULL), '~~') END, '~', chr(10)) AS answer FROM supplier""".replace("### Protect yourself", "### Protect yourself"))
def compose_full_answer(spark, sf_dir):
    r = supplier_records(spark, sf_dir)
    k = F.substring("category", 2, 20).cast("long")
    scam = F.array(F.struct(F.lit("Pay at the desk").alias("claim"), F.lit(None).cast("string").alias("why"), F.lit("gazette").alias("source"), F.lit("2020-01-01").cast("date").alias("source_date"), F.lit(None).cast("string").alias("caveat")))
    m = r.select(k.alias("qid"), F.lit("no hit").alias("rationale"), F.when(k % 17 != 0, F.struct(*[F.col(c) for c in r.columns])).alias("record"), F.when(k % 5 == 0, "stale").otherwise("fresh").alias("level"), F.array(F.lit("old")).alias("notes"), scam.alias("patterns"), F.lit(None).cast("string").alias("lead"))
    return compose.full_answers(m)


@query(f"""SELECT d.doc_id, len(list_filter({NUMS.format(c='d.text')}, lambda x: NOT list_contains(list_concat(list_concat({NUMS.format(c="coalesce(b.text, '')")}, {NUMS.format(c="'over ' || d.doc_id || ' and ' || left(d.text, 200)")}), ['', '0']), x))) = 0 AS accepted FROM documents d LEFT JOIN benchmark b ON d.doc_id % 40 = b.item_id WHERE d.text IS NOT NULL""")
def generated_accepted(spark, sf_dir):
    """Generated texts stand only if facts or question hold all of their numbers."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("facts"))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    j = d.join(b, F.col("doc_id") % 40 == F.col("item_id"), "left")
    question = F.concat(F.lit("over "), F.col("doc_id").cast("string"), F.lit(" and "), F.left("text", F.lit(200)))
    return j.select("doc_id", compose.accepted(F.col("text"), F.col("facts"), question).isNotNull().alias("accepted"))


@query("""SELECT s_suppkey AS qid, 'SERVICE ' || s_name || ' / Service ' || s_suppkey || chr(10) || 'OFFICE Office' || chr(10) || CASE WHEN s_suppkey % 7 = 0 THEN 'CONTACT Desk 1' || chr(10) ELSE '' END || 'DATED ' || CASE WHEN s_suppkey % 8 = 0 THEN 'unknown' ELSE FACTDAY END || chr(10)
|| 'FEE ' || CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'f0' END || ': ' || CASE WHEN s_acctbal <= 0 THEN 'NOT VERIFIED' WHEN floor(s_acctbal) = 0 THEN 'Free' ELSE format('{:,}', CAST(floor(s_acctbal) AS BIGINT)) END || ' (source of ' || FACTDAY || ')' || chr(10) || 'DOCUMENT Form ' || s_suppkey || chr(10) || 'STEP 1. Apply' || chr(10)
|| 'CHUNK a' || chr(10) || 'CHUNK b' || chr(10) || 'WARNING Pay at the desk' || chr(10) || 'NOTE old' || chr(10) || 'SOURCE http://rec/' || s_suppkey % 6 AS facts FROM supplier""".replace("FACTDAY", DAY))
def facts_block(spark, sf_dir):
    r = supplier_records(spark, sf_dir)
    scam, notes = F.array(F.struct(F.lit("Pay at the desk").alias("claim"))), F.array(F.lit("old"))
    return r.select(F.substring("category", 2, 20).cast("long").alias("qid"), compose.facts(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.struct(*[F.col(c) for c in r.columns]), scam, 2, notes).alias("facts"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE text END AS before, CASE WHEN turn % 2 = 0 THEN 'more' END AS summary, CASE WHEN turn % 2 = 0 THEN role END AS inside FROM conversations WHERE text NOT LIKE '%<details>%'")
def details_unfolded(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text not like '%<details>%'")
    md = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("<details><summary>more</summary>"), "role", F.lit("</details>"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", compose.unfolded(md).alias("u")).select("conv_id", "turn", "u.before", "u.summary", "u.inside")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'not verified' WHEN s_suppkey > 365 THEN 'more than a year old: likely out of date' WHEN s_suppkey > 90 THEN 'older than the limit: confirm it' END AS note FROM supplier")
def fee_age_notes(spark, sf_dir):
    status = F.when(F.col("s_suppkey") % 3 == 0, "unverified").otherwise("source_read")
    return table(spark, sf_dir, "supplier").select("s_suppkey", compose.age_note(F.col("s_suppkey"), status).alias("note"))


# ---- pages -----------------------------------------------------------------------------------------

HOST_OF = "lower(regexp_extract({c}, '^[a-zA-Z]+://([^/?#]*)', 1))"


@query(LINK_SQL + f" SELECT url, CAST(pos AS INTEGER) AS pos, target FROM s WHERE regexp_matches(target, '(?i)^https?://') AND ({HOST_OF.format(c='target')} = {HOST_OF.format(c='url')} OR ends_with({HOST_OF.format(c='target')}, '.org') OR ends_with(lower(target), '.pdf'))")
def html_links_followed(spark, sf_dir):
    return html.followed(_links(spark, sf_dir), ".org").select("url", "pos", "target")


@query(LINK_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, label DESC, target DESC) AS r FROM s WHERE target IS NOT NULL)
SELECT url, string_agg(score || ':' || left(label, 70) || ':' || target, chr(10) ORDER BY r) AS links FROM r WHERE r <= 25 GROUP BY url""")
def html_link_preview(spark, sf_dir):
    shown = html.link_preview(_links(spark, sf_dir).where("target is not null"))
    return shown.select("url", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["score"].cast("string"), x["label"], x["target"])), "\n").alias("links"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'html' ELSE 'other' END AS kind FROM pages")
def body_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 6 == 0, "http://h/A.PDF?x=1").otherwise("http://h/a")
    kind = F.when(F.col("page_id") % 6 == 3, "application/pdf").when(F.col("page_id") % 3 == 1, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 2, "image/png")
    return p.select("page_id", html.kind_of(kind, url).alias("kind"))


@query("SELECT page_id, CAST(1 AS BIGINT) AS n_tables, CAST(2 AS BIGINT) AS n_rows, 'a|b' AS first_row, '/l' || page_id AS links FROM pages WHERE NOT regexp_matches(html, '(?i)<table')")
def html_table_preview(spark, sf_dir):
    """Pages without tables, each with one of two rows, one of a single row, and a filled cell's link appended."""
    more = F.concat("html", F.lit("<table><tr><td>a</td><td>b</td></tr><tr><td><a href='/l"), F.col("page_id").cast("string"), F.lit("'>c</a></td></tr><tr><td> </td></tr></table><table><tr><td>x</td></tr></table>"))
    p = table(spark, sf_dir, "pages").where(~F.col("html").rlike("(?i)<table")).select("page_id", html.table_preview(more).alias("t"))
    return p.select("page_id", F.size("t").cast("long").alias("n_tables"), F.size(F.col("t")[0]).cast("long").alias("n_rows"), F.array_join(F.col("t")[0][0]["cells"], "|").alias("first_row"), F.array_join(F.col("t")[0][1]["links"], ",").alias("links"))


@query("SELECT doc_id, 'TK 10,BDT ' || doc_id AS amounts, 'pay TK 10 or BDT ' || doc_id || ' and TK 10 ' AS context FROM documents")
def fee_strings_in_context(spark, sf_dir):
    text = F.concat(F.lit("pay TK 10 or BDT "), F.col("doc_id").cast("string"), F.lit(" and TK 10 then"))
    d = table(spark, sf_dir, "documents").select("doc_id", html.fee_strings(text).alias("f"))
    first = F.regexp_extract(F.col("f")[0]["context"], "^(.*TK 10 )", 1)
    return d.select("doc_id", F.array_join(F.transform("f", lambda x: x["amount"]), ",").alias("amounts"), first.alias("context"))


@query("SELECT doc_id, array_to_string(list_slice(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the')), 1, 5), '|') AS lines FROM documents WHERE text IS NOT NULL")
def lines_with_part(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(agent.lines_with(F.col("text"), "the", 5), "|").alias("lines"))


# ---- fonts, vectors, attempts ----------------------------------------------------------------------

LETTERS = {"a": "ক", "e": "ে", "th": "ত", "qu": "খ", "r": "র্", "i": "ি", "o": "া"}
CLUSTER = r"[\x{0995}-\x{09b9}\x{09ce}\x{09dc}-\x{09df}](?:\x{09cd}[\x{0995}-\x{09b9}\x{09ce}\x{09dc}-\x{09df}])*"
LETTER_SQL = "text"
for _from, _to in sorted(LETTERS.items(), key=lambda x: -len(x[0])):
    LETTER_SQL = f"replace({LETTER_SQL}, '{_from}', '{_to}')"


@query(rf"""SELECT doc_id, nfc_normalize(regexp_replace(regexp_replace({LETTER_SQL}, '([\x{{09bf}}\x{{09c7}}\x{{09c8}}])({CLUSTER})', '\2\1', 'g'), '({CLUSTER})([\x{{09be}}-\x{{09cc}}]*)\x{{09b0}}\x{{09cd}}', chr(2480) || chr(2509) || '\1\2', 'g')) AS text,
round(1 - length(regexp_replace(text, '[\sA-Za-z0-9.,:;()\[\]/%"''\-]', '', 'g')) / greatest(length(regexp_replace(text, '\s', '', 'g')), 1), 6) AS coverage FROM documents""")
def legacy_decode(spark, sf_dir):
    """Documents through a small table with signs that stand before and r-signs behind their letters."""
    d = table(spark, sf_dir, "documents").select("doc_id", fonts.decode(F.col("text"), LETTERS).alias("d"))
    return d.select("doc_id", "d.text", F.round("d.coverage", 6).alias("coverage"))


@query()
def embed_hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", embed.embed(F.col("text"), "passage", embed.HashedGrams(32)).alias("v"))


@query("""WITH e AS (SELECT user_id AS url, event_id AS seq, CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 200 ELSE 404 END AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
p AS (SELECT url, max(status) FILTER (r = 1) AS a, max(status) FILTER (r = 2) AS b FROM e GROUP BY url)
SELECT url, CASE WHEN a = 429 AND b IS NOT NULL THEN 2 ELSE 1 END AS tries, CASE WHEN a = 429 AND b IS NOT NULL THEN b ELSE a END AS status,
CASE WHEN a = 200 THEN 'ok' WHEN a = 429 AND b IS NULL THEN 'waiting' WHEN a = 429 AND b = 200 THEN 'recovered' WHEN a = 429 AND b = 429 THEN 'blocked' ELSE 'failed' END AS outcome FROM p""")
def attempts_retried(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "view", 200).otherwise(404)
    return agent.retried(e.select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), status.alias("status")))


@query("SELECT CAST(i AS INTEGER) AS step, 'count' AS tool, '{\"lang\": \"' || l || '\"}' AS args, true AS ok, CAST((SELECT count(*) FROM documents WHERE lang = l) AS VARCHAR) AS result FROM (VALUES (0, 'de'), (1, 'en'), (2, 'fr')) t(i, l)")
def agent_episode(spark, sf_dir):
    """A queue of planned calls, one of them twice, over a tool that counts documents."""
    d = table(spark, sf_dir, "documents")
    tools = agent.Registry({"count": agent.Tool(lambda lang: d.where(F.col("lang") == lang).count(), "documents of a language", {"lang": "string"})})
    return agent.episode(spark, tools, agent.Queue([("count", {"lang": x}) for x in ("de", "en", "de", "fr")]))

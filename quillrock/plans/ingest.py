"""Queries of what brings sources in: record builders, schema conformance, the validation run."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import deep, urls
from ..operators import builders, conform, html, ingestion, records, tools
from ..session import shared_folder
from ..sources import fetch
from ..streaming import rescrape
from .catalogue import DRIFT, snapshot
from .registry import literal, query, table

#: Rules and heads of the kinds of pages that the queries plant.
RULES = [
    builders.text_rule("licence", "fees", r"(Ordinary|Fast) service in (\d+) days: TK (?:[\d,]+|on request)", "{r1}_{s1}units_{s2}yr", "{s1} units, {s2} years, {r1} ({r2} days)", r"TK ([\d,]+)", r"Licence of (\d+) units for (\d+) years"),
    builders.table_rule("births", "rates", "birth_{n}", first=builders.TABLE_ROW),
    builders.docs_rule("births", "documents", "^দলিল", 2, least_cells=3),
    builders.table_rule("deaths", "rates", "death_{n}", term="মৃত্যু"),
]
HEADS = """('licence', 'driving_licence', 'Driving licence', 'x', 'Office', CAST(NULL AS STRING), CAST(NULL AS STRING), array(named_struct('step', 'Apply online', 'where', 'portal')), CAST(NULL AS STRING)),
('births', 'birth_registration', 'Birth registration', 'x', 'Office', 'https://b.example.org', '16100', CAST(NULL AS ARRAY<STRUCT<step: STRING, where: STRING>>), NULL),
('deaths', 'death_registration', 'Death registration', 'x', 'Office', NULL, NULL, NULL, NULL), ('bare', 'nid_correction', 'Card correction', 'x', 'Office', NULL, NULL, NULL, 'behind a login')"""


def planted(spark, sf_dir):
    """Pages with a service's text or table before their own: a quarter of each kind."""
    n = F.col("page_id")
    licence = F.concat(
        F.lit("<h2>Licence of 48 units for 5 years</h2><p>Ordinary service in 15 days: TK "), F.format_number(1000 + n, 0), F.lit("</p><p>Fast service in 2 days: TK "), F.when(n % 3 == 0, "on request").otherwise("9,000"),
        F.lit("</p><h2>Licence of 64 units for 10 years</h2><p>Ordinary service in 20 days: TK 12,000</p>"),
    )
    births = F.concat(
        F.lit("<table><tr><th>No</th><th>Service</th><th>Rate</th></tr><tr><td>১</td><td>A "), n.cast("string"), F.lit("</td><td>বিনা ফিসে</td></tr><tr><td>২</td><td>B</td><td>"), F.translate(n.cast("string"), "0123456789", "০১২৩৪৫৬৭৮৯"),
        F.lit(" টাকা</td></tr><tr><td>৩</td><td>C</td><td>আলোচনা</td></tr><tr><td>৪</td><td>short</td></tr><tr><td>দলিল</td><td>list</td><td>১) first document of all; ২) the second document</td></tr></table>"),
    )
    deaths = F.concat(F.lit("<table><tr><td>a</td><td>মৃত্যু সনদ</td><td>25 টাকা</td></tr><tr><td>b</td><td>জন্ম সনদ</td><td>50 টাকা</td></tr></table><table><tr><td>c</td><td>মৃত্যু</td><td>75 টাকা</td></tr></table>"))
    kind = F.element_at(F.array(*map(F.lit, ("licence", "births", "deaths", "bare"))), (n % 4 + 1).cast("int"))
    own = F.when(kind == "licence", licence).when(kind == "births", births).when(kind == "deaths", deaths).otherwise("")
    updated = F.when(n % 6 < 4, F.date_add(F.lit("2026-01-01").cast("date"), (n % 90).cast("int")))
    return table(spark, sf_dir, "pages").select(n.alias("doc_id"), kind.alias("kind"), "url", F.concat(own, F.coalesce("html", F.lit(""))).alias("html"), updated.alias("updated"))


def built(spark, sf_dir):
    heads = literal(spark, HEADS, "kind, category, service_name_en, service_name_bn, office, apply_portal, contact, steps, why")
    return builders.records(builders.cut(planted(spark, sf_dir), builders.rule_table(spark, RULES)), heads, F.lit("2026-05-01"), "reader")


@query("""WITH k AS (SELECT page_id AS doc_id, page_id % 4 AS kind FROM pages)
SELECT doc_id, 'driving_licence' AS category, fee_key, label, amount, CASE WHEN amount IS NULL THEN 'unverified' ELSE 'source_read' END AS status, raw FROM (
  SELECT doc_id, 'ordinary_48units_5yr' AS fee_key, '48 units, 5 years, Ordinary (15 days)' AS label, 1000 + doc_id AS amount, NULL AS raw FROM k WHERE kind = 0
  UNION ALL SELECT doc_id, 'fast_48units_5yr', '48 units, 5 years, Fast (2 days)', CASE WHEN doc_id % 3 <> 0 THEN 9000 END, CASE WHEN doc_id % 3 = 0 THEN 'Fast service in 2 days: TK on request' END FROM k WHERE kind = 0
  UNION ALL SELECT doc_id, 'ordinary_64units_10yr', '64 units, 10 years, Ordinary (20 days)', 12000, NULL FROM k WHERE kind = 0)
UNION ALL SELECT doc_id, 'birth_registration', 'birth_01', 'A ' || doc_id, 0, 'source_read', NULL FROM k WHERE kind = 1
UNION ALL SELECT doc_id, 'birth_registration', 'birth_02', 'B', doc_id, 'source_read', NULL FROM k WHERE kind = 1
UNION ALL SELECT doc_id, 'birth_registration', 'birth_03', 'C', NULL, 'unverified', 'আলোচনা' FROM k WHERE kind = 1
UNION ALL SELECT doc_id, 'death_registration', 'death_01', 'মৃত্যু সনদ', 25, 'source_read', NULL FROM k WHERE kind = 2""")
def records_built_fees(spark, sf_dir):
    """Fees that the rules of three kinds read out of the pages; what can't be read stays unverified."""
    f = built(spark, sf_dir).select("doc_id", "category", F.explode("fees").alias("f"))
    return f.select("doc_id", "category", "f.fee_key", F.col("f.label_en").alias("label"), F.col("f.amount_bdt").cast("long").alias("amount"), F.col("f.verification.status").alias("status"), F.col("f.raw_text").alias("raw"))


@query("""SELECT page_id AS doc_id, CASE page_id % 4 WHEN 0 THEN 'driving_licence' WHEN 1 THEN 'birth_registration' WHEN 2 THEN 'death_registration' ELSE 'nid_correction' END AS category,
CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS n_fees, CASE WHEN page_id % 4 = 1 THEN '১) first document of all;|২) the second document' ELSE '' END AS docs,
CASE WHEN page_id % 4 = 3 THEN 'unverified' ELSE 'source_read' END AS status, CASE WHEN page_id % 4 = 3 THEN 'not ingestible yet: behind a login' ELSE '' END AS notes,
CASE WHEN page_id % 4 <> 3 AND page_id % 6 < 4 THEN DATE '2026-01-01' + CAST(page_id % 90 AS INTEGER) END AS updated FROM pages""")
def records_built(spark, sf_dir):
    """One record a page, stubs among them."""
    docs = F.flatten(F.transform("variants", lambda v: F.transform(v["required_docs"], lambda d: d["doc"])))
    return built(spark, sf_dir).select("doc_id", "category", F.size("fees").alias("n_fees"), F.array_join(docs, "|").alias("docs"), F.col("verification.status").alias("status"), F.array_join("notes", "|").alias("notes"), F.col("source_last_updated").alias("updated"))


#: A schema with the keywords that records use.
CUSTOMER = {
    "type": "object", "required": ["id", "name", "fees"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0}, "name": {"type": "string", "minLength": 1}, "tags": {"type": "array", "minItems": 1, "items": {"type": "string"}},
        "fees": {"type": "array", "items": {"type": "object", "required": ["key", "check"], "properties": {"key": {"type": "string"}, "amount": {"type": ["number", "null"]}, "check": {"$ref": "#/definitions/check"}}}},
    },
    "definitions": {"check": {"type": "object", "required": ["status"], "properties": {"status": {"enum": ["read", "unread"]}}}},
}


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 12 AS m FROM customer)
SELECT id, a AS at, r AS rule, d AS detail FROM c JOIN (VALUES (1, 'name', 'type', 'string'), (2, '', 'required', 'name'), (3, '', 'additionalProperties', 'zz'), (4, 'fees/1/amount', 'type', 'number or null'),
(5, 'fees/0', 'required', 'key'), (6, 'fees/0/check/status', 'enum', '["read", "unread"]'), (7, '', 'broken', 'no JSON'), (8, 'id', 'type', 'integer'), (9, 'tags', 'minItems', '1'), (10, '', 'type', 'object'),
(11, 'name', 'minLength', '1'), (11, 'fees/1/check', 'type', 'object')) t(m, a, r, d) USING (m)""")
def schema_breaches(spark, sf_dir):
    """Texts of customers, of which eleven in twelve break the schema in a way of their own."""
    m = F.col("c_custkey") % 12
    say = lambda at, bad, good: F.when(m == at, bad).otherwise(good)
    body = F.concat(
        F.lit('{"id": '), F.col("c_custkey").cast("string"), say(8, ".5", ""), say(2, "", F.concat(F.lit(', "name": '), F.when(m == 1, "null").when(m == 11, '""').otherwise(F.concat(F.lit('"'), "c_name", F.lit('"'))))),
        say(3, ', "zz": [1]', ""), say(9, ', "tags": []', ', "tags": ["a"]'), F.lit(', "fees": [{'), say(5, "", '"key": "k", '), F.lit('"check": {"status": "'), say(6, "perhaps", "read"),
        F.lit('"}, "other": 1}, {"key": "b", "amount": '), say(4, '"9"', F.when(m == 0, "null").otherwise("9.25")), F.lit(', "check": '), say(11, "3", '{"status": "unread"}'), F.lit("}]"), say(7, "", "}"),
    )
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(m == 10, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("body"))
    return conform.check(texts, CUSTOMER, "id")


def record_schema() -> dict:
    """The schema of a record, from its type."""
    must = ("category", "service_name_en", "service_name_bn", "office", "source_url", "last_scraped_date", "source_last_updated", "verification", "verification.status", "fees.fee_key", "fees.amount_bdt", "fees.source_url", "fees.verification", "fees.verification.status", "variants.variant_id", "variants.label_en")
    sure = tuple(p for p in must if p not in ("source_last_updated", "fees.amount_bdt"))
    status = ["unverified", "source_read", "human_confirmed"]
    return conform.schema_from(StructType.fromDDL(records.RECORD), must, sure, {"verification.status": status, "fees.verification.status": status})


@query("""WITH k AS (SELECT page_id AS path, page_id AS n, page_id % 4 AS kind, page_id % 7 = 2 AS cut, page_id % 6 < 4 AS dated, DATE '2026-01-01' + CAST(page_id % 90 AS INTEGER) AS updated FROM pages)
SELECT path, 'error' AS severity, 'schema:broken' AS rule, 'no JSON' AS detail FROM k WHERE cut
UNION ALL SELECT path, 'error', 'schema:additionalProperties', 'extra' FROM k WHERE NOT cut AND n % 11 = 3
UNION ALL SELECT path, 'error', 'schema:type', 'office string' FROM k WHERE NOT cut AND n % 13 = 5
UNION ALL SELECT path, 'error', 'unknown_category', 'death_registration' FROM k WHERE NOT cut AND kind = 2
UNION ALL SELECT path, 'error', 'scam_text', 'bribe' FROM k WHERE NOT cut AND n % 17 = 4
UNION ALL SELECT path, 'warning', 'undated_record', '' FROM k WHERE NOT cut AND kind <> 3 AND NOT dated
UNION ALL SELECT path, 'warning', 'old_record', '' FROM k WHERE NOT cut AND kind <> 3 AND dated AND updated < DATE '2026-05-01' - 90
UNION ALL SELECT path, 'warning', 'old_fee', '' FROM k, (VALUES (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 1)) f(fk, i) WHERE NOT cut AND kind = fk AND dated AND updated < DATE '2026-05-01' - 90 AND NOT (kind = 0 AND i = 2 AND n % 3 = 0)""")
def validation_run(spark, sf_dir):
    """Built records as JSON texts, some spoilt, through schema, categories, curated words, rules of fees and ages."""
    n = F.col("doc_id")
    body = F.to_json(F.struct(*records.FIELDS), {"ignoreNullFields": "false"})
    body = F.when(n % 11 == 3, F.concat(F.lit('{"extra": 1, '), F.substring(body, 2, 2**31 - 1))).otherwise(body)
    body = F.when(n % 13 == 5, F.replace(body, F.lit('"office":"Office"'), F.lit('"office":7'))).otherwise(body)
    body = F.when(n % 17 == 4, F.replace(body, F.lit('"service_name_bn":"x"'), F.lit('"service_name_bn":"BRIBE"'))).otherwise(body)
    texts = built(spark, sf_dir).select(n.alias("path"), F.when(n % 7 == 2, F.left(body, F.length(body) - 5)).otherwise(body).alias("body"))
    valid = literal(spark, "('driving_licence'), ('birth_registration'), ('nid_correction')", "id")
    return conform.validate(texts, record_schema(), valid, F.lit("2026-05-01").cast("date"), ("bribe", "dalal"), "anti-dalal fact")


@query(DRIFT + """ SELECT url, 'source_date' AS kind, DATE '2021-03-10' AS was, DATE '2021-03-11' AS now, '' AS removed, '' AS added, TIMESTAMP '2026-02-01' AS visited FROM d WHERE dated
UNION ALL SELECT url, 'amounts', NULL, NULL, '100', '101', TIMESTAMP '2026-02-01' FROM d WHERE priced""")
def rescrape_stream(spark, sf_dir):
    """Two snapshots as a stream: the second comes with the first's visits replayed, and only changed facts come out."""
    at = shared_folder(spark, "rescrape")

    def visit(shift: int, day: str):
        pages = snapshot(spark, sf_dir, shift)
        facts = html.page_facts(pages if shift else pages.where("page_id % 13 <> 0"))
        return facts.select("url", "updated", F.col("amounts").cast("array<long>").alias("amounts"), "text_sha1", F.lit(day).cast("timestamp").alias("visited"))

    first = visit(0, "2026-01-01")
    first.write.mode("append").parquet(f"{at}/visits")
    rescrape.run(spark, f"{at}/visits", f"{at}/changes", f"{at}/progress")
    visit(1, "2026-02-01").unionByName(first).write.mode("append").parquet(f"{at}/visits")
    found = rescrape.findings(rescrape.run(spark, f"{at}/visits", f"{at}/changes", f"{at}/progress"))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("removed", "added")})


AGENT_RULES = ingestion.Rules(keywords=(("charter", 5), ("list", 3)), suffix=".org")


def site(spark, sf_dir):
    """Pages as an office's site: each links a list page of its own and a page to leave; lists link documents. Bodies are the documents' texts with fee lines."""
    n = F.col("page_id")
    text = n.cast("string")
    p = table(spark, sf_dir, "pages").select(n, F.concat(F.lit("http://office.org/"), text).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    home = p.select("url", F.concat("html", F.lit("<a href='/l"), text, F.lit("/list'>charter list</a><a href='/l"), text, F.lit("/other'>list of transfer</a>")).alias("html"))
    row = lambda cell, to: F.concat(F.lit(f"<tr><td>{cell}</td><td><a href='../d/"), to, F.lit(".pdf'>get</a></td></tr>"))
    lists = p.where(n % 10 != 9).select(F.concat(F.lit("http://office.org/l"), text, F.lit("/list")).alias("url"), F.concat(F.lit("<table>"), row("ফি তালিকা", text), row("notes", F.lit("x")), row("term", (n + 1).cast("string")), F.lit("</table>")).alias("html"))
    k = F.col("doc_id")
    line = F.when(k % 3 == 0, F.concat(F.lit("\nসেবা "), F.translate((k + 10).cast("string"), "0123456789", "০১২৩৪৫৬৭৮৯"), F.lit(" টাকা\n৫ ভাগের ৬ টাকা"))).when(k % 3 == 1, "\nহার ৭ টাকার মধ্যে".replace("টাকার মধ্যে", "প্রতি")).otherwise("")
    bodies = table(spark, sf_dir, "documents").select(F.concat(F.lit("http://office.org/d/"), k.cast("string"), F.lit(".pdf")).alias("url"), F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~\n]", ""), F.lit("\nplain words about an office and its service\n"), line).alias("text"), (k % 7 != 6).alias("is_pdf"), F.lit(False).alias("corrected"))
    seeds = F.array(F.col("url"), F.when(n % 4 == 0, F.concat(F.lit("http://office.org/"), (n + 1).cast("string"))))
    categories = p.select(F.concat(F.lit("c"), text).alias("category"), F.array(F.when(n % 2 == 0, "term").otherwise("nothing")).alias("terms"), seeds.alias("seeds"))
    return categories, home.unionByName(lists), bodies


@query()
def ingestion_outcomes(spark, sf_dir):
    """Every category's episode at once; tests hold it against a queue worked through one action at a time."""
    categories, pages, bodies = site(spark, sf_dir)
    trace = ingestion.actions(categories, pages, bodies, None, AGENT_RULES)
    found = ingestion.outcomes(categories, trace)
    return found.select("category", "outcome", "step", "source_url", F.array_join(F.transform("fees", lambda f: F.concat_ws(":", f["fee_key"], f["amount"].cast("string"))), ",").alias("fees"))


@query("""WITH c AS (SELECT page_id AS id, page_id % 8 AS k FROM pages), d AS (SELECT count(*) AS n FROM documents)
SELECT id AS call_id, CASE k WHEN 0 THEN 'fetch_page' WHEN 1 THEN 'extract_tables' WHEN 2 THEN 'detect_pdf' WHEN 3 THEN 'decode_pdf' WHEN 4 THEN 'parse_fee' WHEN 5 THEN 'no_such' WHEN 6 THEN 'fetch_page' ELSE 'extract_tables' END AS tool, k NOT IN (5, 6, 7) AND NOT (k = 3 AND id % 7 = 6) AS ok,
CASE k WHEN 5 THEN 'unknown tool no_such; known: discover_links, fetch_page, extract_tables, detect_pdf, decode_pdf, parse_fee' WHEN 6 THEN 'fetch_page: wrong or missing arguments text, url' WHEN 7 THEN 'nothing is known of http://office.org/none' WHEN 3 THEN CASE WHEN id % 7 = 6 THEN 'refused: not_a_pdf' END END AS error,
CASE k WHEN 1 THEN 'ফি তালিকা' WHEN 2 THEN CASE WHEN id % 7 = 6 THEN 'not_a_pdf' ELSE 'known' END WHEN 3 THEN CASE WHEN id % 7 <> 6 THEN CASE WHEN id % 3 = 0 THEN '2' ELSE '0' END END WHEN 4 THEN CAST(id AS VARCHAR) END AS told FROM c WHERE id % 10 <> 9""")
def tool_calls(spark, sf_dir):
    """A call a page, answered in one plan: results, refusals and wrong calls alike."""
    categories, pages, bodies = site(spark, sf_dir)
    n = table(spark, sf_dir, "pages").where("page_id % 10 <> 9").select("page_id")
    i = F.col("page_id")
    text = i.cast("string")
    at = lambda path, end="": F.create_map(F.lit("url"), F.concat(F.lit("http://office.org/" + path), text, F.lit(end)))
    args = {
        0: ("fetch_page", at("")), 1: ("extract_tables", at("l", "/list")), 2: ("detect_pdf", at("d/", ".pdf")), 3: ("decode_pdf", F.map_concat(at("d/", ".pdf"), F.create_map(F.lit("contains"), F.lit("টাকা")))), 4: ("parse_fee", F.create_map(F.lit("text"), F.concat(text, F.lit(" টাকা")))),
        5: ("no_such", at("")), 6: ("fetch_page", F.create_map(F.lit("text"), text)), 7: ("extract_tables", F.create_map(F.lit("url"), F.lit("http://office.org/none"))),
    }
    tool, given = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for k, (name, a) in args.items():
        tool, given = F.when(i % 8 == k, name).otherwise(tool), F.when(i % 8 == k, a).otherwise(given)
    got = tools.answer(n.select(i.alias("call_id"), tool.alias("tool"), given.alias("args")), pages, bodies, None, keywords=AGENT_RULES.keywords, suffix=".org")
    r = lambda path: F.get_json_object("result", path)
    kind = r("$.encoding")
    told = F.when(F.col("tool") == "extract_tables", r("$.preview[0][0].cells[0]")).when(F.col("tool") == "detect_pdf", F.when(kind == "not_a_pdf", kind).otherwise("known")).when(F.col("tool") == "decode_pdf", F.when(kind.isNull(), r("$.matched"))).when(F.col("tool") == "parse_fee", r("$.fees[0].amount"))
    return got.select("call_id", "tool", "ok", "error", F.when(F.col("ok"), told).alias("told"))


@query("""SELECT doc_id AS id, nfc_normalize(text || chr(2527)) AS inner_text, nfc_normalize('e' || chr(769) || lang) AS key, nfc_normalize(source) AS value, n_chars FROM documents""")
def nested_nfc(spark, sf_dir):
    """Strings inside arrays, structs and maps, keys too."""
    d = table(spark, sf_dir, "documents")
    nested = d.select("doc_id", "n_chars", F.array(F.struct(F.concat("text", F.lit("য়")).alias("t"))).alias("l"), F.when(F.col("lang").isNotNull(), F.create_map(F.concat(F.lit("é"), "lang"), "source")).alias("m"))
    out = deep.deep_nfc(nested)
    return out.select(F.col("doc_id").alias("id"), F.col("l")[0]["t"].alias("inner_text"), F.get(F.map_keys("m"), F.lit(0)).alias("key"), F.get(F.map_values("m"), F.lit(0)).alias("value"), "n_chars")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://h.example.org/' || page_id || '/%E0%A6%B8%E0%A7%87%E0%A6%AC%E0%A6%BE%20x?q=%E0%A7%A7&r=%20#top' ELSE url END AS uri FROM pages")
def addresses_to_ask(spark, sf_dir):
    """Half of the pages under Bengali paths; addresses that are ASCII stay as they are."""
    n = F.col("page_id")
    odd = F.concat(F.lit("http://h.example.org/"), n.cast("string"), F.lit("/সেবা x?q=১&r=%20#top"))
    return table(spark, sf_dir, "pages").select("page_id", urls.to_uri(F.when(n % 2 == 0, odd).otherwise(F.col("url"))).alias("uri"))


@query("SELECT url, bool_or(page_id % 3 <> 0) AS from_cache, CASE WHEN bool_or(page_id % 3 <> 0) THEN 200 ELSE 404 END AS status, CASE WHEN bool_or(page_id % 3 <> 0) THEN max(octet_length(encode(html))) FILTER (page_id % 3 <> 0) ELSE 0 END AS bytes FROM (SELECT DISTINCT ON (url, page_id % 3 <> 0) * FROM pages WHERE url IS NOT NULL ORDER BY url, page_id % 3 <> 0, page_id) GROUP BY url")
def pages_visited(spark, sf_dir):
    """Two thirds of the pages stand in the cache; the rest are asked of a tree of files that holds none of them."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    first = F.min_by(F.struct("url", "html"), "page_id")
    cache = p.where("page_id % 3 <> 0").groupBy("url").agg(first.alias("p")).select("url", F.lit(200).alias("status"), F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), F.encode("p.html", "UTF-8").alias("body"), F.lit("2026-01-01").cast("timestamp").alias("fetched_at"))
    seen = fetch.visited(p.select("url"), cache, "quillrock.sources.fetch:file_tree", per_host=10**9, blocks=10**9)
    return seen.select("url", "from_cache", "status", "bytes")

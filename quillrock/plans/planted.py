"""Queries of operators whose cases the tables don't hold of themselves: cases are planted into each table's rows, by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, fees, fonts, lang, text
from ..operators import audit, classify, compose, evaluate, html, records
from ..sources import sinks
from . import ingest
from .answering import supplier_records
from .catalogue import AGE, AS_OF, HOST
from .registry import literal, query, table

BN, ASCII = text.BENGALI_DIGITS, "0123456789"


def bn(c):
    return F.translate(c.cast("string"), ASCII, BN)


def bn_sql(c: str) -> str:
    return f"translate(CAST({c} AS VARCHAR), '{ASCII}', '{BN}')"


def cases(key, by: int, values: dict, other=None):
    """The value for key % by."""
    out = F.lit(other) if not hasattr(other, "_jc") else other
    for k, v in values.items():
        out = F.when(key % by == k, v).otherwise(out)
    return out


@query("SELECT lower(trim(p_type)) AS alias, count(*) AS n, count(DISTINCT p_brand) AS n_categories FROM part GROUP BY 1 HAVING count(*) > 1")
def alias_ambiguity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return classify.ambiguous(p.select(F.col("p_brand").alias("category"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_type"), F.lit(" "))).otherwise(F.col("p_type")).alias("alias")))


BARE = "NOT regexp_matches(coalesce(html, ''), '(?i)<table')"


def _tables(spark, sf_dir, before):
    """Pages without tables of their own, with some before their text."""
    p = table(spark, sf_dir, "pages").where(~F.coalesce("html", F.lit("")).rlike("(?i)<table"))
    return p.select(F.col("page_id").alias("id"), F.posexplode(html.tables(F.concat(before, F.coalesce("html", F.lit(""))))).alias("table_no", "rows"))


@query(f"SELECT page_id AS id, t, r, c, replace(cell, '~', CAST(page_id AS VARCHAR)) AS cell FROM pages, (VALUES (0, 0, 0, 'Service'), (0, 0, 1, 'Fee'), (0, 1, 0, 'Deed ~'), (0, 1, 1, '~ TK'), (1, 0, 0, 'a < b')) v(t, r, c, cell) WHERE {BARE}".replace(" t, r, c,", " t AS table_no, r AS row_no, c AS col_no,", 1))
def html_tables_explode(spark, sf_dir):
    n = F.col("page_id").cast("string")
    before = F.concat(F.lit('<table><tr><th>Service</th><th>Fee</th></tr><tr><td><a href="/x">Deed '), n, F.lit("</a></td><td>"), n, F.lit('&nbsp;TK</td></tr><tr><td> </td><td></td></tr></table><p>x</p><TABLE class="t"><TR><TD>a &amp;lt; b</TD></TR></TABLE>'))
    return _tables(spark, sf_dir, before).select("id", "table_no", F.posexplode("rows").alias("row_no", "r")).select("id", "table_no", "row_no", F.posexplode("r").alias("col_no", "cell"))


def _fee_tables(spark, sf_dir):
    row = "<tr><td>1</td><td>2</td><td>3</td></tr>"
    first = "<table><tr><th>Service</th><th>Fee</th></tr><tr><td>a</td><td>1</td></tr></table><table><tr><th>No</th><th>Service name</th><th>Fee due</th></tr>" + row * 2
    last = "</table><table><tr><th>Other</th></tr>" + "<tr><td>1</td></tr>" * 5 + "</table>"
    return _tables(spark, sf_dir, F.concat(F.lit(first), F.when(F.col("page_id") % 2 == 0, row).otherwise(""), F.lit(last)))


@query(f"SELECT page_id AS id, 1 AS table_no, CASE WHEN page_id % 2 = 0 THEN 4 ELSE 3 END AS n_rows FROM pages WHERE {BARE}")
def widest_fee_table(spark, sf_dir):
    return audit.widest_table(_fee_tables(spark, sf_dir), ("service", "fee"))


@query(f"SELECT page_id AS id, t AS table_no, s AS service, f AS fee FROM pages, (VALUES (0, 0, 1), (1, 1, 2), (2, NULL, NULL)) v(t, s, f) WHERE {BARE}")
def header_columns(spark, sf_dir):
    found = audit.header_columns(F.get("rows", F.lit(0)), {"service": "service", "fee": "fee"})
    return _fee_tables(spark, sf_dir).select("id", "table_no", found.alias("h")).select("id", "table_no", "h.*")


@query(f"""SELECT DISTINCT host, length(host) % 4 = 0 AS closed, CAST(CASE length(host) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS n_disallow, CASE WHEN length(host) % 4 = 1 THEN 10 END AS delay FROM (SELECT {HOST} AS host FROM pages)""")
def robots_rules(spark, sf_dir):
    """One file a host, read once for all of its pages."""
    hosts = table(spark, sf_dir, "pages").select(html.host(F.col("url")).alias("host")).distinct()
    body = cases(F.length("host"), 4, {0: "User-agent: *\nDisallow: /", 1: "User-agent: *\nDisallow: /admin # x\nDisallow: /tmp\nCrawl-delay: 10", 2: "User-agent: *\nDisallow:", 3: ""})
    return hosts.select("host", audit.robots_rules(F.concat(F.lit("Sitemap: http://"), "host", F.lit("\n"), body)).alias("r")).select("host", "r.*")


def _audited(spark, sf_dir):
    n, s = F.col("n_nationkey"), F.col("s_suppkey").cast("string")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    categories = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.array(name(n), name(n + 80)).alias("sources"))
    final = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("http://f/"), s))
    return categories, table(spark, sf_dir, "supplier").select(name(F.col("s_suppkey")).alias("id"), (F.col("s_acctbal") > 3000).alias("reachable"), final.alias("final_url"), F.concat(F.lit("http://u/"), s).alias("url"))


WANTED = "WITH w AS (SELECT n_name AS category, unnest([n_nationkey, n_nationkey + 80]) AS k FROM nation)"


@query(f"{WANTED} SELECT category, 's' || k AS source, CASE WHEN k % 2 = 0 THEN 'http://f/' ELSE 'http://u/' END || k AS url FROM w JOIN supplier ON k = s_suppkey WHERE s_acctbal > 3000")
def sources_usable(spark, sf_dir):
    return audit.usable_sources(*_audited(spark, sf_dir))


@query(f"{WANTED} SELECT category, 's' || k AS source, CASE WHEN s_suppkey IS NULL THEN 'not_audited' ELSE 'unreachable' END AS problem FROM w LEFT JOIN supplier ON k = s_suppkey WHERE s_suppkey IS NULL OR NOT s_acctbal > 3000")
def source_problems(spark, sf_dir):
    return audit.source_problems(*_audited(spark, sf_dir))


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 11 = 0 THEN 'unverified' WHEN o_orderkey % 3 = 1 THEN 'stale' WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN {AGE} > 90 THEN 'stale' ELSE 'fresh' END AS level FROM orders""")
def freshness_precedence(spark, sf_dir):
    """Missing, unverified, an old fee, no date, the record's own age: the first that holds."""
    k = F.col("o_orderkey")
    fee = dates.age_days(cases(k, 3, {0: F.lit("1998-09-01").cast("date"), 1: F.lit("1990-01-01").cast("date")}, F.lit(None).cast("date")), AS_OF)
    own = dates.age_days(F.when(k % 5 != 0, F.col("o_orderdate").cast("date")), AS_OF)
    return table(spark, sf_dir, "orders").select(k.alias("id"), dates.freshness(own, fee, F.when(k % 11 == 0, "unverified").otherwise("source_read"), k % 7 != 0).alias("level"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def bengali_dates(spark, sf_dir):
    """Dates in Bengali and ASCII digits, a month known by its head only, impossible days, other words, nothing."""
    spelt = {n: name for name, n in reversed(dates.MONTHS)}
    o, d = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.element_at(F.array(*(F.lit(spelt[i]) for i in range(1, 13))), F.month(d))
    raw = cases(o, 5, {0: F.concat(F.lit("সোমবার, "), bn(F.dayofmonth(d)), F.lit(" "), name, F.lit(", "), bn(F.year(d))), 1: F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), name, F.lit("X "), F.year(d).cast("string")), 2: F.concat(F.lit("31 "), F.lit(spelt[2]), F.lit(" "), F.year(d).cast("string")), 3: F.concat(F.lit("5 blah "), F.year(d).cast("string"))}, "")
    return table(spark, sf_dir, "orders").select(o.alias("id"), dates.bengali_date(raw).alias("d"))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN make_date(2022, 4, CAST(1 + doc_id % 28 AS INTEGER)) WHEN 1 THEN make_date(2019, 5, CAST(1 + doc_id % 28 AS INTEGER)) END AS updated, CASE doc_id % 3 WHEN 0 THEN 'cms_footer' WHEN 1 THEN 'content_marker' END AS kind FROM documents")
def staleness_extract(spark, sf_dir):
    k, own = F.col("doc_id"), F.coalesce("text", F.lit(""))
    page = cases(k, 3, {0: F.concat(own, F.lit("\nপাতাটি হাল নাগাদ হয়েছে: রবিবার, "), bn(1 + k % 28), F.lit(" এপ্রিল, ২০২২")), 1: F.concat(F.lit("foo Last updated: "), (1 + k % 28).cast("string"), F.lit(" মে 2019 bar "), own)}, own)
    return table(spark, sf_dir, "documents").select(k.alias("id"), dates.staleness(page).alias("s")).select("id", "s.updated", "s.kind")


@query("""WITH s AS (SELECT 's' || s_suppkey AS category, s_suppkey AS k, s_name AS n FROM supplier)
SELECT category || '::identity' AS id, category, 'identity' AS chunk_kind, n || ' | Service ' || k || ' | Office' AS text FROM s UNION ALL SELECT category || '::v::steps', category, 'steps', n || ' V — process: 1. Apply' FROM s
UNION ALL SELECT category || '::v::doc0', category, 'required_doc', n || ' V — required document: Form ' || k FROM s UNION ALL SELECT category || '::fee_labels', category, 'fee_labels', n || ' Service ' || k || ' — fee categories: ' || CASE WHEN k % 2 = 0 THEN n ELSE 'f0' END FROM s""")
def record_chunks(spark, sf_dir):
    return records.chunks(supplier_records(spark, sf_dir))


@query("""WITH k AS (SELECT page_id AS n, page_id % 4 AS kind, CASE page_id % 4 WHEN 0 THEN 'driving_licence' WHEN 1 THEN 'birth_registration' ELSE 'death_registration' END AS category FROM pages)
SELECT category, 'unknown_category' AS rule FROM k WHERE kind = 2
UNION ALL SELECT category, 'amount_without_verification' FROM k, (VALUES (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 1)) f(fk, i) WHERE kind = fk AND n % 5 = 0 AND NOT (kind = 0 AND i = 2 AND n % 3 = 0)""")
def record_constraints(spark, sf_dir):
    """Records built from pages, a fifth of whose fees have lost their verification."""
    rec = ingest.built(spark, sf_dir).withColumn("fees", F.when(F.col("doc_id") % 5 == 0, F.transform("fees", lambda f: f.withField("verification", f["verification"].withField("status", F.lit("unverified"))))).otherwise(F.col("fees")))
    return records.violations(rec, literal(spark, "('driving_licence'), ('birth_registration'), ('nid_correction')", "id"))


@query("""WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'Part' || p_partkey WHEN p_partkey % 7 = 0 THEN 'unknown_service' ELSE 'part_' || p_partkey END AS id, len(CASE WHEN p_partkey % 2 = 0 THEN list_slice(string_split(p_type, ' '), 1, 1) ELSE string_split(p_type, ' ') END) + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n FROM part)
SELECT id, 'not_snake_case' AS rule FROM t WHERE k % 5 = 0 UNION ALL SELECT id, 'reserved' FROM t WHERE k % 5 <> 0 AND k % 7 = 0 UNION ALL SELECT id, 'few_aliases' FROM t WHERE n < 3 UNION ALL SELECT id, 'no_bengali_alias' FROM t WHERE k % 3 <> 0""")
def taxonomy_constraints(spark, sf_dir):
    k = F.col("p_partkey")
    name = k.cast("string")
    ident = F.when(k % 5 == 0, F.concat(F.lit("Part"), name)).when(k % 7 == 0, "unknown_service").otherwise(F.concat(F.lit("part_"), name))
    words = F.split("p_type", " ")
    aliases = F.concat(F.when(k % 2 == 0, F.slice(words, 1, 1)).otherwise(words), F.when(k % 3 == 0, F.array(F.lit("দলিল"))).otherwise(F.array().cast("array<string>")))
    return records.taxonomy_rules(table(spark, sf_dir, "part").select(ident.alias("id"), aliases.alias("aliases")))


@query("SELECT category, amount FROM (SELECT l_orderkey AS category, CAST(l_quantity AS BIGINT) AS amount FROM lineitem WHERE l_linenumber <= 2) p ANTI JOIN (SELECT l_orderkey AS category, CAST(l_quantity AS BIGINT) AS amount FROM lineitem WHERE l_linenumber > 2) k USING (category, amount)")
def grounding_amounts(spark, sf_dir):
    """Amounts of an order's first two lines that none of its others has."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("category"), F.col("l_quantity").cast("long").alias("amount"), "l_linenumber")
    return audit.unsupported_amounts(li.where("l_linenumber <= 2").select("category", "amount"), li.where("l_linenumber > 2"))


@query("SELECT doc_id AS id, problem FROM documents, (VALUES (0, 'fees_unverified'), (0, 'date_missing'), (0, 'documents_unverified'), (1, 'source_missing'), (1, 'date_missing'), (3, 'fees_without_record')) v(k, problem) WHERE doc_id % 4 = k")
def safety_violations(spark, sf_dir):
    k, own = F.col("doc_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"))
    md = F.concat(own, cases(k, 4, {0: "### Documents\n- Form\n\n### Fees\nx http://a", 1: "no link", 2: "### Fees\nhttp://c Source last updated"}, "### Fees"))
    url = cases(k, 4, {0: "http://a", 1: "http://nowhere.example", 2: "http://c"}, "http://d")
    found = evaluate.safety_problems(md, cases(k, 4, {0: "unverified", 1: "source_read", 2: "source_read"}, F.lit(None).cast("string")), url, "Fees", "Documents", ["Source last updated"])
    return table(spark, sf_dir, "documents").select(k.alias("id"), F.explode(found).alias("problem"))


@query(f"""WITH q AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN left(text, 60) WHEN 1 THEN 'আমার ' || left(text, 30) WHEN 2 THEN left(text, 100) || ' koto taka' ELSE 'parcel koto ' || split_part(text, ' ', 1) END AS q FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, q, len(regexp_extract_all(lower(q), '[a-z]+')) AS words, len(list_filter(regexp_extract_all(lower(q), '[a-z]+'), lambda w: list_contains({list(lang.ROMANISED)!r}, w))) AS hits FROM q)
SELECT id, CASE WHEN regexp_matches(q, '[\\x{{0980}}-\\x{{09ff}}]') OR hits >= 2 OR (hits = 1 AND words <= 4) THEN 'bn' ELSE 'en' END AS lang FROM w""")
def lang_detect(spark, sf_dir):
    """Heads of texts as questions: of their own, with Bengali script, with two romanised words, with one among few."""
    head = lambda n: F.left("text", F.lit(n))
    q = cases(F.col("doc_id"), 4, {0: head(60), 1: F.concat(F.lit("আমার "), head(30)), 2: F.concat(head(100), F.lit(" koto taka"))}, F.concat(F.lit("parcel koto "), F.split_part("text", F.lit(" "), F.lit(1))))
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), lang.detect(q).alias("lang"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN (p_partkey + 10) || ',620' WHEN 4 THEN '0' WHEN 1 THEN CAST(p_partkey + 10 AS VARCHAR) WHEN 6 THEN CAST(p_partkey + 10 AS VARCHAR) WHEN 8 THEN CAST(p_partkey + 10 AS VARCHAR) ELSE '' END AS amounts,
CASE p_partkey % 9 WHEN 0 THEN 'split' WHEN 1 THEN 'single' WHEN 2 THEN 'no_amount' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'free' WHEN 5 THEN 'empty' WHEN 6 THEN 'single' WHEN 7 THEN 'not_split' ELSE 'single' END AS outcome FROM part""")
def fee_parse_cells(spark, sf_dir):
    """Cells of every kind, each part's number in its own."""
    k = F.col("p_partkey")
    a, put = bn(k + 10), lambda before, after: F.concat(F.lit(before), bn(k + 10), F.lit(after))
    cell = cases(k, 9, {
        0: put("ক) ছোট পার্সেল ", "/-টাকা (ভ্যাটসহ) (খ) বড় ৬২০/- টাকা"), 1: F.concat("p_name", F.lit(" "), a, F.lit("/- টাকা (ভ্যাটসহ)")), 2: F.lit("মূল দামের ৫ ভাগের ২ ভাগ"), 3: put("সব মিলে ", "/- টাকা, কিস্তি ৭০০/- টাকা"), 4: F.lit("বিনামূল্যে"),
        6: put("", " টাকা [ব্যাংকের তালিকা ৫০ টাকা]"), 7: put("", " টাকা ২০০ টাকা"), 8: put("", ".৫০ টাকা"),
    }, "")
    p = table(spark, sf_dir, "part").select(k.alias("id"), fees.parse_fee_cell(cell).alias("p"))
    return p.select("id", F.array_join(F.col("p.amounts").cast("array<string>"), ",").alias("amounts"), "p.outcome")


@query("""SELECT p_partkey AS id, pos, replace(item, '~', p_name) AS item FROM part, (VALUES (0, 0, '১) ~ দুই পাতার খসড়া চিঠি।'), (0, 1, '২) খাম (আকার ৪-৯) সহ ৬) ছবি ছাড়া'), (0, 2, '৩) ডাক মাশুলের রসিদ'), (1, 0, '~ no list here at all')) v(k, pos, item) WHERE p_partkey % 3 = k""")
def split_numbered_docs(spark, sf_dir):
    k = F.col("p_partkey")
    cell = cases(k, 3, {0: F.concat(F.lit("১) "), "p_name", F.lit(" দুই পাতার খসড়া চিঠি। ২) খাম (আকার ৪-৯) সহ ৬) ছবি ছাড়া ৩) ডাক মাশুলের রসিদ")), 1: F.concat("p_name", F.lit(" no list here at all"))}, "")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(fees.split_numbered(cell)).alias("pos", "item"))


FORMS = (("\u09df", "\u09af\u09bc"), ("\u09dc", "\u09a1\u09bc"), ("e\u0301", "\u00e9"), ("a", "b"))


@query("SELECT doc_id AS id, nfc_normalize(text || a) = nfc_normalize(text || b) AS same FROM documents JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(FORMS)) + ") v(k, a, b) ON doc_id % 4 = k WHERE text IS NOT NULL")
def nfc_equality(spark, sf_dir):
    """Texts that end in two forms of one letter, or in two letters."""
    k = F.col("doc_id")
    form = lambda i: text.nfc(F.concat("text", cases(k, 4, {n: F.lit(pair[i]) for n, pair in enumerate(FORMS)})))
    return table(spark, sf_dir, "documents").where("text is not null").select(k.alias("id"), (form(0) == form(1)).alias("same"))


@query("""SELECT p_brand AS font, p_partkey AS code, was, g AS text FROM (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'ক' ELSE 'খ' END END AS was, CASE p_size % 3 WHEN 0 THEN 'ক' WHEN 1 THEN 'খ' END AS g FROM part) WHERE was IS DISTINCT FROM g""")
def cmap_corrections(spark, sf_dir):
    """Glyphs whose font says something else than their map, over the parts of every brand."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    maps = p.where("p_partkey % 7 <> 0").select(F.col("p_brand").alias("font"), F.col("p_partkey").alias("code"), F.when(size % 2 == 0, "ক").otherwise("খ").alias("text"))
    glyphs = p.select(F.col("p_brand").alias("font"), F.col("p_partkey").alias("gid"), cases(size, 3, {0: F.lit("ক"), 1: F.lit("খ")}, F.lit(None).cast("string")).alias("text"))
    return fonts.corrections(maps, glyphs)


@query("""SELECT id, try_cast(replace(x, ',', '') AS BIGINT) AS amount, id % 100 >= 80 AS reported FROM (SELECT doc_id AS id, unnest(regexp_extract_all(coalesce(text, '') || ' 1,' || (doc_id + 100), '[0-9][0-9,]{1,}')) AS x FROM documents)""")
def ocr_candidates(spark, sf_dir):
    """Numbers in recognised lines of documents, one of each in Bengali digits; those of low confidence are kept back."""
    k = F.col("doc_id")
    lines = F.split(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), bn(F.lit(1)), F.lit(","), bn(k + 100)), "\n")
    d = table(spark, sf_dir, "documents").select(k.alias("id"), F.explode(lines).alias("line"), ((k % 100) / 100).alias("confidence"))
    return audit.scanned_amounts(d)


@query("""SELECT p_partkey AS id, pos, replace(item, '~', p_name) AS item FROM part, (VALUES (0, 0, '1) ~ two pages of a draft'), (0, 1, '(২) the receipt of 5) postage'), (0, 2, '3) and a photograph'), (1, 0, '~ without any number')) v(k, pos, item) WHERE p_partkey % 3 = k""")
def split_docs_anywhere(spark, sf_dir):
    k = F.col("p_partkey")
    cell = cases(k, 3, {0: F.concat(F.lit("1) "), "p_name", F.lit(" two pages of a draft(২) the receipt of 5) postage 3) and a photograph 4) short")), 1: F.concat("p_name", F.lit(" without any number"))}, "tiny")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(fees.split_docs(cell)).alias("pos", "item"))


@query(f"""WITH o AS (SELECT o_orderkey, {AGE} AS d FROM orders) SELECT o_orderkey, CASE WHEN d < 365 THEN {bn_sql('d')} || ' {dates.AGO}' ELSE '{dates.ABOUT} ' || {bn_sql('d // 365')} || ' {dates.YEARS}, ' || {bn_sql('d % 365')} || ' {dates.AGO}' END AS age FROM o""")
def age_text_bengali(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.age_text(dates.age_days(F.col("o_orderdate").cast("date"), AS_OF), "bn").alias("age"))


def _answers(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.floor(F.abs(F.col("s_acctbal"))).cast("long")
    fee = lambda name, amount: F.struct(F.lit(name).alias("label"), amount.cast("long").alias("amount"))
    status = F.when(k % 3 == 0, "unverified").otherwise("source_read")
    m = table(spark, sf_dir, "supplier").select(
        k.alias("qid"), F.when(k % 2 == 0, "en").otherwise("bn").alias("lang"), F.when(k % 7 != 0, F.col("s_name")).alias("title"), status.alias("status"), F.when(k % 3 == 0, "unverified").when(k % 5 == 0, "stale").otherwise("fresh").alias("level"),
        F.array(F.lit("Form A"), F.concat(F.lit("Photo "), k.cast("string"))).alias("docs"), F.array(fee("Base", n), fee("Copy", F.lit(0)), fee("Late", F.lit(None))).alias("fees"), F.concat(F.lit("http://a/"), k.cast("string")).alias("source_url"),
    )
    return compose.answers(m)


BASE = "CAST(floor(abs(s_acctbal)) AS BIGINT)"


@query(f"""SELECT s_suppkey AS qid, CASE WHEN s_suppkey % 7 = 0 THEN '## No matching service' ELSE replace('## ' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN '~~> Source is unverified.' WHEN s_suppkey % 5 = 0 THEN '~~> Source is stale.' ELSE '' END ||
CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '~~### Documents~- Form A~- Photo ' || s_suppkey || '~~### Fees~| Base | ' || CASE WHEN {BASE} = 0 THEN 'Free' WHEN s_suppkey % 2 = 0 THEN format('{{:,}}', {BASE}) ELSE {bn_sql("format('{:,}', " + BASE + ")").replace('{:,}', '{{:,}}').replace('{{', '{').replace('}}', '}')} || ' / ' || format('{{:,}}', {BASE}) END || ' |~| Copy | Free |~| Late | NOT VERIFIED |' END || '~~Source: http://a/' || s_suppkey, '~', chr(10)) END AS answer FROM supplier""")
def compose_answer(spark, sf_dir):
    return _answers(spark, sf_dir)


@query(f"SELECT s_suppkey AS qid, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 3 = 0 THEN '' ELSE {BASE} || ',0' END AS amounts FROM supplier")
def answer_fee_amounts(spark, sf_dir):
    written = text.to_ascii_digits(F.regexp_replace("answer", r"\| [০-৯,]+ / ", "| "))
    return _answers(spark, sf_dir).select("qid", F.array_join(audit.fee_table_amounts(written).cast("array<string>"), ",").alias("amounts"))


@query("SELECT p_partkey AS src, p_partkey + d AS dst FROM part, range(1, 5) r(d) WHERE p_partkey % 5 + d <= 4 AND p_partkey + d - 1 <= (SELECT max(p_partkey) FROM part)")
def substitution_closure(spark, sf_dir):
    """Chains of up to five parts."""
    k = F.col("p_partkey")
    return audit.closure(table(spark, sf_dir, "part").where(k % 5 != 4).select(k.alias("src"), (k + 1).alias("dst")))


@query("SELECT c_custkey, 'unverified' AS status FROM customer WHERE c_custkey % 3 = 0")
def drafts_forced_unverified(spark, sf_dir):
    k = F.col("c_custkey")
    found = table(spark, sf_dir, "customer").select("c_custkey", cases(k, 3, {0: F.lit("citizens"), 1: F.lit(" ")}, F.lit(None).cast("string")).alias("audience_check"), F.when(k % 2 == 0, "source_read").otherwise("human_confirmed").alias("status"))
    return sinks.drafts(found).select("c_custkey", "status")

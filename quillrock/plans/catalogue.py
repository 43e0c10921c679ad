"""Queries of the retrieval and record operators over the shared tables, each with its SQL.

Stand-ins: embeddings.label and documents.lang for a category, benchmark for a curated table, pages for
crawled pages, events for a request log, orders for dated records, lineitem for child rows.
Small fixed rows stand as literals on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, fees, fonts, lang, text
from ..functions.vectors import dot
from ..operators import audit, classify, compose, crawl, drift, html, records, retrieval
from .registry import ORACLES, QUERIES, literal, query, table  # noqa: F401

# ---- retrieval -------------------------------------------------------------------------------------

VEC = "SELECT vec_id AS {p}id, CAST(embedding AS DOUBLE[]) AS {p}vec, label FROM embeddings"
SCORED = "round(list_inner_product(q.qvec, c.cvec), 6)"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("category"))
    return q, e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), F.col("label").alias("category"))


@query(f"""WITH q AS ({VEC.format(p='q')}), c AS ({VEC.format(p='c')})
SELECT qid, cid, {SCORED} AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY {SCORED} DESC, cid) AS INTEGER) AS rank
FROM q JOIN c ON q.label = c.label AND qid <> cid WHERE qid % 25 = 0 QUALIFY rank <= 5""")
def retrieve_topk_in_category(spark, sf_dir):
    return retrieval.top_k(*_vectors(spark, sf_dir), 5, "category")


@query(f"""WITH q AS ({VEC.format(p='q')}), c AS ({VEC.format(p='c')})
SELECT qid, cid, {SCORED} AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY {SCORED} DESC, cid) AS INTEGER) AS rank
FROM q JOIN c ON qid <> cid WHERE qid % 25 = 0 QUALIFY rank <= 5""")
def retrieve_topk_global(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    return retrieval.top_k(q.drop("category"), c.drop("category"), 5)


@query(f"""WITH q AS ({VEC.format(p='q')}), c AS ({VEC.format(p='c')}),
w AS (SELECT qid, cid, q.label AS ql, c.label AS cl, {SCORED} AS score, row_number() OVER (PARTITION BY qid ORDER BY {SCORED} DESC, cid) AS r FROM q JOIN c ON qid <> cid WHERE qid % 25 = 0 QUALIFY r <= 40)
SELECT qid, cid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS INTEGER) AS rank FROM w WHERE ql = cl QUALIFY rank <= 5""")
def retrieve_postfilter_oversample(spark, sf_dir):
    return retrieval.post_filtered(*_vectors(spark, sf_dir), 5)


@query("""WITH p AS (SELECT label AS pid, i, round(avg(x), 5) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, i),
e AS (SELECT vec_id AS qid, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT qid, pid, round(sum(x * m), 6) AS score FROM e JOIN p USING (i) GROUP BY qid, pid),
b AS (SELECT qid, pid, score, round(score - lead(score) OVER w, 6) AS gap, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY qid ORDER BY score DESC, pid))
SELECT qid, CASE WHEN score >= 0.2 AND coalesce(gap >= 0.015, true) THEN CAST(pid AS VARCHAR) ELSE 'unknown_service' END AS category, score, gap FROM b WHERE r = 1""")
def classify_profile_margin(spark, sf_dir):
    """Label centroids as profiles: one row a label, so the broadcast is as small as the taxonomy."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("m"))
    profiles = parts.groupBy(F.col("label").alias("pid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("pvec"))
    return retrieval.classify(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), profiles, 0.2, 0.015, "unknown_service")


ALIASES = "('tion', 'the', 0), ('tion', 'thetion', 1), ('quer', 'que', 2), ('quer', 'queaux', 3), ('haus', 'ung', 4), ('none', '', 5)"


def _named(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), text.norm(F.col("text")).alias("norm"))
    return q, literal(spark, ALIASES, "category, alias, pos")


HITS = f"""WITH a AS (SELECT * FROM (VALUES {ALIASES}) t(category, alias, pos)),
q AS (SELECT doc_id AS qid, nfc_normalize(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS norm FROM documents),
h AS (SELECT qid, category, arg_max(alias, (len(alias), -pos)) AS alias FROM q JOIN a ON alias <> '' AND contains(norm, alias) GROUP BY qid, category)"""


@query(f"{HITS} SELECT * FROM h")
def classify_alias_longest(spark, sf_dir):
    return classify.alias_hits(*_named(spark, sf_dir))


@query(f"""{HITS}, p AS (SELECT qid, count(*) AS n, min(category) AS only_one FROM h GROUP BY qid)
SELECT q.qid, coalesce(n, 0) AS n_hits, CASE WHEN n = 1 THEN only_one ELSE 'unknown_service' END AS category,
CASE WHEN n = 1 THEN 'alias' WHEN n > 1 THEN 'alias+embedding' ELSE 'embedding' END AS method FROM q LEFT JOIN p ON q.qid = p.qid""")
def classify_routed(spark, sf_dir):
    q, a = _named(spark, sf_dir)
    return classify.route(q, classify.alias_hits(q, a))


# ---- pages -----------------------------------------------------------------------------------------

WS = r"[ \t\n\x0b\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
VISIBLE = rf"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(HTML, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '"'), '{WS}', ' ', 'g'))"""


@query(f"SELECT page_id, {VISIBLE.replace('HTML', 'html')} AS text FROM pages")
def html_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html")).alias("text"))


STRIPPED = VISIBLE[VISIBLE.index("regexp_replace(regexp_replace(HTML") : VISIBLE.index(", '&nbsp;'")]


@query(rf"""WITH p AS (SELECT page_id, url, page_id % 7 AS k, coalesce(html, '') || CASE WHEN page_id % 4 = 0 THEN '<p>%E0%A6%95+%E0%A6%96 100%</p>' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '<input name=x type="password">' WHEN page_id % 5 = 1 THEN '<b type=password>' ELSE '' END
|| CASE WHEN page_id % 3 = 0 THEN '<a href="/d/a.pdf?x=1">a</a><a href="/d/a.pdf?x=1">b</a><a href="http://o.org/B.PDF">c</a><a href="/pdf">d</a>' ELSE '' END AS html,
CASE page_id % 6 WHEN 0 THEN url || '/' WHEN 1 THEN 'http://moved.example.org/x' ELSE url END AS final FROM pages),
v AS (SELECT *, CASE WHEN k = 0 THEN '' ELSE {VISIBLE.replace(STRIPPED, f"url_decode({STRIPPED})").replace('HTML', 'html')} END AS t FROM p)
SELECT page_id, left(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 160) AS title, length(t) AS visible_chars, length(regexp_replace(t, '[^\x{{0980}}-\x{{09ff}}]', '', 'g')) AS bengali_chars, k > 1 AND length(t) < 400 AS likely_js,
page_id % 5 = 0 AS login_wall, page_id % 6 = 1 AS redirected, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS n_pdf,
CASE WHEN page_id % 3 = 0 THEN array_to_string(list_sort([regexp_extract(final, '^([a-z]+://[^/?#]*)', 1) || '/d/a.pdf?x=1', 'http://o.org/B.PDF']), ' ') ELSE '' END AS pdfs FROM v""")
def html_titles_and_signals(spark, sf_dir):
    """Pages with percent codes, password inputs, PDF links, redirects and kinds of bodies: all signals from one look."""
    k, on = F.col("page_id"), lambda n, at, text: F.when(F.col("page_id") % n == at, text)
    more = F.concat(
        F.coalesce("html", F.lit("")), on(4, 0, "<p>%E0%A6%95+%E0%A6%96 100%</p>").otherwise(""), on(5, 0, '<input name=x type="password">').when(k % 5 == 1, "<b type=password>").otherwise(""),
        on(3, 0, '<a href="/d/a.pdf?x=1">a</a><a href="/d/a.pdf?x=1">b</a><a href="http://o.org/B.PDF">c</a><a href="/pdf">d</a>').otherwise(""),
    )
    kind = on(7, 0, "application/pdf").when(k % 7 == 1, "text/plain").otherwise("Text/HTML; charset=utf-8")
    final = F.when(k % 6 == 0, F.concat("url", F.lit("/"))).when(k % 6 == 1, "http://moved.example.org/x").otherwise(F.col("url"))
    p = table(spark, sf_dir, "pages").select("page_id", "url", more.alias("html"), kind.alias("content_type"), final.alias("final_url"))
    return html.signals(p).withColumn("pdfs", F.array_join("pdfs", " "))


def _links(spark, sf_dir):
    found = html.links(table(spark, sf_dir, "pages"))
    found = found.withColumn("target", html.resolve(F.col("url"), F.col("href")))
    return found.withColumn("score", html.keyword_score(F.lower(F.concat_ws(" ", "label", "target")), F.col("target"), PAGE_WORDS))


#: The pages hold invented words; these stand for the vocabulary, over the same operator.
PAGE_WORDS = (("the", 5), ("th", 2), ("que", 4), ("fee", 5), ("form", 2))
PAGE_SCORE = " + ".join(f"CASE WHEN contains(blob, '{w}') THEN {n} ELSE 0 END" for w, n in PAGE_WORDS) + " + CASE WHEN ends_with(lower(target), '.pdf') THEN 3 ELSE 0 END"
LINK_SQL = rf"""WITH m AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 0)) AS tag, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 0), 1) - 1 AS pos FROM pages),
x AS (SELECT url, pos, regexp_extract(tag, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1) AS href, regexp_extract(tag, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2) AS inner_html FROM m),
l AS (SELECT url, pos, href, left({VISIBLE.replace('HTML', 'inner_html')}, 90) AS label FROM x WHERE NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)')),
t AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || href ELSE NULL END AS target FROM l),
s AS (SELECT url, pos, label, target, CAST({PAGE_SCORE} AS INTEGER) AS score FROM (SELECT *, lower(label || ' ' || target) AS blob FROM t))"""


@query(LINK_SQL + " SELECT url, CAST(pos AS INTEGER) AS pos, label, target, score FROM s")
def html_links_scored(spark, sf_dir):
    return _links(spark, sf_dir).select("url", "pos", "label", "target", "score")


@query(LINK_SQL + " SELECT url, target, arg_max(score, (score, length(label), -pos)) AS score, arg_max(label, (score, length(label), -pos)) AS label FROM s WHERE score > 0 GROUP BY url, target")
def best_link_per_url(spark, sf_dir):
    return html.best_links(_links(spark, sf_dir))


HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"


@query(f"SELECT {HOST} AS host, count(*) AS n_pages, count(DISTINCT url) AS n_urls FROM pages GROUP BY 1")
def host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(html.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("url").alias("n_urls"))


@query(f"""WITH r AS (SELECT DISTINCT {HOST} AS host, contains({HOST}, 'm.') AS restricted FROM pages)
SELECT page_id, host, restricted FROM (SELECT page_id, {HOST} AS host FROM pages) p JOIN r USING (host)""")
def pages_by_host_robots(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", html.host(F.col("url")).alias("host"))
    robots = p.select("host", F.col("host").contains("m.").alias("restricted")).dropDuplicates(["host"])
    return p.join(robots, "host").select("page_id", "host", "restricted")


FACTS = f"""SELECT url, page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '[0-9][0-9,]{{1,}}\\s*/?-?\\s*টাকা|TK\\s*[0-9,]+|BDT\\s*[0-9,]+', 0), lambda x: try_cast(regexp_replace(x, '[^0-9]', '', 'g') AS BIGINT)), lambda x: x > 0))) AS amounts, sha1(t) AS text_sha1, length(t) AS chars
FROM (SELECT url, page_id, nfc_normalize({VISIBLE.replace('HTML', 'html')}) AS t FROM pages)"""


@query(f"SELECT url, array_to_string(list_transform(amounts, lambda x: CAST(x AS VARCHAR)), ',') AS amounts, text_sha1, chars FROM ({FACTS})")
def page_facts(spark, sf_dir):
    f = html.page_facts(table(spark, sf_dir, "pages"))
    return f.select("url", F.array_join(F.col("amounts").cast("array<string>"), ",").alias("amounts"), "text_sha1", F.col("chars").cast("long").alias("chars"))


DRIFT = """WITH k AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url),
d AS (SELECT url, page_id, page_id % 13 = 0 AS fresh, page_id % 13 <> 0 AND page_id % 7 = 0 AS priced, page_id % 13 <> 0 AND page_id % 17 = 0 AS dated, page_id % 11 = 0 AS worded FROM k)"""


def snapshot(spark, sf_dir, shift: int):
    """Pages, one a url, with a price line and an update mark; snapshot 1 changes some prices, dates and texts."""
    first = Window.partitionBy("url").orderBy("page_id")
    p = table(spark, sf_dir, "pages").withColumn("r", F.row_number().over(first)).where("r = 1")
    price = F.when(F.col("page_id") % 7 == 0, 100 + shift).otherwise(F.col("page_id") + 1)
    day = F.when(F.col("page_id") % 17 == 0, 10 + shift).otherwise(5)
    mark = F.concat(F.lit("<p>Last updated: "), day.cast("string"), F.lit(" মার্চ 2021 </p>"))
    return p.withColumn("html", F.concat("html", F.lit("<p>TK "), price.cast("string"), F.lit("</p>"), mark, F.when(F.col("page_id") % 11 == 0, F.lit(f"<p>v{shift}</p>")).otherwise("")))


def _compared(spark, sf_dir):
    return drift.compared(html.page_facts(snapshot(spark, sf_dir, 0).where("page_id % 13 <> 0")), html.page_facts(snapshot(spark, sf_dir, 1)))


@query(DRIFT + """ SELECT url, 'source_date' AS kind, DATE '2021-03-10' AS was, DATE '2021-03-11' AS now, '' AS removed, '' AS added FROM d WHERE dated
UNION ALL SELECT url, 'amounts', NULL, NULL, '100', '101' FROM d WHERE priced""")
def snapshot_drift(spark, sf_dir):
    found = drift.findings(_compared(spark, sf_dir))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("removed", "added")})


@query(DRIFT + " SELECT url, CASE WHEN fresh THEN 'new' WHEN priced OR dated THEN 'changed' WHEN worded THEN 'text' ELSE 'identical' END AS status FROM d")
def snapshot_status(spark, sf_dir):
    return _compared(spark, sf_dir).select("url", "status")


@query(DRIFT + """ SELECT count(*) AS checked, count(*) FILTER (priced OR dated) AS findings, count(*) FILTER (fresh) AS n_new, count(*) FILTER (priced OR dated) AS n_changed,
count(*) FILTER (NOT fresh AND NOT priced AND NOT dated AND worded) AS n_text, count(*) FILTER (NOT fresh AND NOT priced AND NOT dated AND NOT worded) AS n_identical, (SELECT count(*) FROM pages WHERE page_id % 19 = 0) AS errors FROM d""")
def rescrape_report(spark, sf_dir):
    return drift.run_report(_compared(spark, sf_dir), table(spark, sf_dir, "pages").where("page_id % 19 = 0"))


INDEX = f"SELECT DISTINCT url, {HOST} AS category FROM pages"


@query(f"{DRIFT} SELECT {HOST} AS category, count(*) AS n_urls FROM d WHERE priced OR dated GROUP BY 1")
def drift_affected_rollup(spark, sf_dir):
    index = table(spark, sf_dir, "pages").select("url", html.host(F.col("url")).alias("category")).distinct()
    return drift.affected(drift.findings(_compared(spark, sf_dir)), index)


@query("""SELECT target, count(DISTINCT url) AS n_pages, min(url) AS first_page FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS target FROM pages) GROUP BY target""")
def url_inverted_index(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), 1))).alias("target"))
    return p.groupBy("target").agg(F.countDistinct("url").alias("n_pages"), F.min("url").alias("first_page"))


# ---- dates and freshness ---------------------------------------------------------------------------

AS_OF = "1998-10-01"
AGE = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}')"
@query(f"""SELECT o_orderkey, {AGE} AS age_days, CASE WHEN o_orderstatus = 'P' THEN 'unverified' WHEN {AGE} > 90 THEN 'stale' ELSE 'fresh' END AS level FROM orders""")
def freshness_levels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    age = dates.age_days(F.col("o_orderdate").cast("date"), AS_OF)
    status = F.when(F.col("o_orderstatus") == "P", "unverified").otherwise("source_read")
    return o.select("o_orderkey", age.cast("long").alias("age_days"), dates.freshness(age, F.lit(None).cast("int"), status, F.lit(True)).alias("level"))


@query(f"""SELECT o_orderkey, CASE WHEN {AGE} < 365 THEN {AGE} || ' days ago' ELSE 'about ' || CAST(floor({AGE} / 365) AS BIGINT) || ' year' || CASE WHEN {AGE} >= 730 THEN 's' ELSE '' END || ', ' || {AGE} % 365 || ' days ago' END AS age FROM orders""")
def freshness_age_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.age_text(dates.age_days(F.col("o_orderdate").cast("date"), AS_OF)).alias("age"))


@query(f"""SELECT c_nationkey, max({AGE}) AS worst_age, arg_max(o_orderkey, ({AGE}, -o_orderkey)) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def worst_age_per_group(spark, sf_dir):
    age = dates.age_days(F.col("o_orderdate").cast("date"), AS_OF)
    j = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", age.alias("age")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey").agg(F.max("age").cast("long").alias("worst_age"), F.max_by("o_orderkey", F.struct("age", -F.col("o_orderkey"))).alias("o_orderkey"))


# ---- lookups, records, chunks ----------------------------------------------------------------------

PATTERNS = "('BUILDING', 'p1', 0), ('BUILDING', 'p2', 1), ('MACHINERY', 'p3', 2)"


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def record_left_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query(f"""SELECT c_custkey, coalesce(string_agg(id, ',' ORDER BY pos), '') AS patterns FROM customer LEFT JOIN (VALUES {PATTERNS}) t(category, id, pos) ON c_mktsegment = category GROUP BY c_custkey""")
def pattern_lookup_1n(spark, sf_dir):
    p = literal(spark, PATTERNS, "category, id, pos").groupBy("category").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("p"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.join(F.broadcast(p), F.col("c_mktsegment") == F.col("category"), "left").select("c_custkey", F.coalesce(F.array_join(F.transform("p", lambda x: x["id"]), ","), F.lit("")).alias("patterns"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def record_without_dimension(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, doc_id || '::line' || (i - 1) AS id, (i) || '. ' || l AS text FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l FROM documents)""")
def chunk_explode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    return d.select("doc_id", "pos", F.concat(F.col("doc_id").cast("string"), F.lit("::line"), F.col("pos").cast("string")).alias("id"), F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "l").alias("text"))


@query("""SELECT lang, CASE WHEN length(l) < 80 THEN 'short' ELSE 'long' END AS chunk_kind, count(*) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY ALL""")
def chunk_kind_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("l"))
    return d.groupBy("lang", F.when(F.length("l") < 80, "short").otherwise("long").alias("chunk_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, count(*) AS n_rows, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS rows, 'row' || lpad(CAST(count(*) AS VARCHAR), 2, '0') AS last_key FROM lineitem GROUP BY l_orderkey""")
def record_fold_from_rows(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), rows.alias("r"))
    return g.select("l_orderkey", "n_rows", "first_part", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("rows"), F.concat(F.lit("row"), F.lpad(F.col("n_rows").cast("string"), 2, "0")).alias("last_key"))


# ---- checks of numbers and documents ---------------------------------------------------------------

NUMS = "list_sort(list_distinct(list_transform(regexp_extract_all({c}, '([0-9][0-9,]*)', 1), lambda x: CASE WHEN ltrim(replace(x, ',', ''), '0') = '' THEN '0' ELSE ltrim(replace(x, ',', ''), '0') END)))"


@query(f"""SELECT d.doc_id, len({NUMS.format(c='d.text')}) AS n_numbers, array_to_string(list_sort(list_filter({NUMS.format(c='d.text')}, lambda x: NOT list_contains(list_concat(CASE WHEN b.text IS NULL THEN [] ELSE {NUMS.format(c='b.text')} END, ['', '0']), x))), ',') AS unsupported
FROM documents d LEFT JOIN benchmark b ON d.doc_id % 40 = b.item_id""")
def numbers_validate(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", text.number_set(F.col("text")).alias("known"))
    d = table(spark, sf_dir, "documents").select("doc_id", text.number_set(F.col("text")).alias("used"))
    j = d.join(b, F.col("doc_id") % 40 == F.col("item_id"), "left")
    allowed = F.array_union(F.coalesce("known", F.array().cast("array<string>")), F.array(F.lit(""), F.lit("0")))
    return j.select("doc_id", F.size("used").cast("long").alias("n_numbers"), F.array_join(F.array_sort(F.array_except("used", allowed)), ",").alias("unsupported"))


@query("""SELECT item_id FROM benchmark b WHERE b.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, left(b.text, 60)) OR contains(b.text, left(d.text, 60)))""")
def grounding_docs(spark, sf_dir):
    """Passages of which no document holds the head, and that hold no document's head."""
    b = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", "text")
    return audit.ungrounded(b, "item_id", "text", table(spark, sf_dir, "documents").select("text"), "text")


@query("SELECT doc_id, contains(lower(text), 'idiot') OR contains(lower(text), 'scum') AS has_forbidden, contains(lower(text), 'the') AND contains(lower(text), 'tion') AS has_required FROM documents")
def contains_assertions(spark, sf_dir):
    t = F.lower("text")
    must, never = F.array(F.lit("the"), F.lit("tion")), F.array(F.lit("idiot"), F.lit("scum"))
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(never, lambda w: F.contains(t, w)).alias("has_forbidden"), F.forall(must, lambda w: F.contains(t, w)).alias("has_required"))


@query("SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS passed, round(avg(quality), 6) AS pass_rate, round(avg(toxic), 6) AS violation_rate FROM labels")
def eval_scores(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("passed"), F.round(F.avg("quality"), 6).alias("pass_rate"), F.round(F.avg("toxic"), 6).alias("violation_rate"))


# ---- text measures ---------------------------------------------------------------------------------

TERMS = ("the", "tion", "que")


@query("SELECT doc_id, " + ", ".join(f"CAST((length(text) - length(replace(text, '{t}', ''))) / {len(t)} AS BIGINT) AS n_{t}" for t in TERMS) + " FROM documents")
def term_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(text.occurrences(F.col("text"), t).alias(f"n_{t}") for t in TERMS))


@query("""SELECT doc_id, round(len(regexp_extract_all(text, '[ঀ-৿]')) / greatest(length(text), 1), 6) AS bengali, round(len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1), 6) AS latin,
len(regexp_extract_all(text, '[A-Za-z]{2,}')) AS n_tokens FROM documents""")
def script_ratios(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p))
    size = F.greatest(F.length("text"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(n("[ঀ-৿]") / size, 6).alias("bengali"), F.round(n("[A-Za-z]") / size, 6).alias("latin"), n("[A-Za-z]{2,}").cast("long").alias("n_tokens"))


#: What stands for the encodings that invented documents don't have, by doc_id % 6; the last sixth keep their own text.
ENCODED = {0: "বাংলাদেশ সরকার ", 1: "েক িখ ", 2: "†K†K KgRK ", 3: "†¶¶¸ ©®", 4: "GIF89a "}
GLYPHS = {"†": "ে", "K": "ক", "g": "ম", "R": "র্"}
ENCODED_TEXT = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN repeat('{v}', 9)" for k, v in ENCODED.items()) + " ELSE text END"


@query(rf"""WITH t AS (SELECT doc_id, text AS own, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS w, {ENCODED_TEXT} AS text FROM documents),
e AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'plain' WHEN 1 THEN 'nikosh_cmap' WHEN 2 THEN 'legacy_bijoy' WHEN 3 THEN 'legacy_bijoy' WHEN 4 THEN 'not_a_pdf' ELSE
CASE WHEN own IS NULL OR length(trim(regexp_replace(own, '{WS}', ' ', 'g'))) < 40 THEN 'empty' WHEN length(regexp_replace(own, '[^†‡¶¸©®÷¤×Ÿ„‹›Œž¥£¢±º»½¾]', '', 'g')) > 5 THEN 'legacy_bijoy'
WHEN len(w) >= 20 AND len(list_filter(w, lambda x: regexp_matches(x, '[aeiouAEIOU]') AND length(x) <= 14)) / len(w) < 0.55 THEN 'legacy_unknown' ELSE 'plain' END END AS encoding FROM t)
SELECT doc_id, encoding, CASE WHEN doc_id % 6 = 1 THEN repeat('কে খি ', 9) WHEN doc_id % 6 = 2 THEN repeat('কেকে কর্মক ', 9) WHEN encoding = 'plain' THEN text END AS decoded, CASE WHEN doc_id % 6 = 2 THEN 1.0 WHEN doc_id % 6 = 3 THEN round(1 - 5 / 6, 6) END AS coverage FROM e""")
def documents_routed(spark, sf_dir):
    """Each class of encoding to its own decoder; what has none, or decodes too little, is refused."""
    text = F.col("text")
    for k, v in ENCODED.items():
        text = F.when(F.col("doc_id") % 6 == k, F.repeat(F.lit(v), F.lit(9))).otherwise(text)
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), (F.col("doc_id") % 6 != 4).alias("is_pdf"), (F.col("doc_id") % 6 == 1).alias("corrected"))
    return fonts.routed(d, GLYPHS, "text", "is_pdf", "corrected").select("doc_id", "encoding", "decoded", F.round("coverage", 6).alias("coverage"))


@query("""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents)
SELECT doc_id, CASE WHEN text IS NULL OR length(trim(regexp_replace(text, 'WHITE', ' ', 'g'))) < 40 THEN 'empty' WHEN len(w) >= 20 AND len(list_filter(w, lambda x: regexp_matches(x, '[aeiouAEIOU]') AND length(x) <= 14)) / len(w) < 0.55 THEN 'legacy_unknown' ELSE 'plain' END AS encoding FROM t""".replace("WHITE", WS))
def encoding_class(spark, sf_dir):
    """Classes that the documents' own texts have."""
    return table(spark, sf_dir, "documents").select("doc_id", fonts.encoding(F.col("text")).alias("encoding"))


@query(f"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: list_contains({list(lang.ROMANISED)!r}, w))) AS hits FROM documents""")
def lang_function_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lang.romanised_hits(F.col("text")).cast("long").alias("hits"))


@query("""SELECT o_orderkey, translate(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), '0123456789', '০১২৩৪৫৬৭৮৯') AS bn FROM orders""")
def digits_translate_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.to_bengali_digits(F.format_number(F.floor("o_totalprice"), 0)).alias("bn"))


# ---- request log -----------------------------------------------------------------------------------

LOG = "SELECT user_id AS host, event_id AS seq, epoch_us(ts) AS ts_us, CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 200 ELSE 404 END AS status FROM events"


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "view", 200).otherwise(404)
    return e.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), status.alias("status"))


@query(f"WITH l AS ({LOG}), g AS (SELECT host, seq, round((ts_us - lag(ts_us) OVER (PARTITION BY host ORDER BY ts_us, seq)) / 1e6, 3) AS gap FROM l) SELECT host, seq, gap, round(greatest(coalesce(6.0::DOUBLE - gap, 0.0::DOUBLE), 0.0::DOUBLE), 3) AS wait FROM g")
def host_request_gap(spark, sf_dir):
    return crawl.gaps(_log(spark, sf_dir)).select("host", "seq", "gap", "wait")


@query(f"WITH l AS ({LOG}) SELECT host, seq, count(*) OVER w AS n, count(*) OVER w <= 25 AS allowed FROM l WINDOW w AS (PARTITION BY host ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)")
def host_rate_budget(spark, sf_dir):
    return crawl.budget(_log(spark, sf_dir)).select("host", "seq", "n", "allowed")


@query(f"""WITH l AS ({LOG}), i AS (SELECT *, sum(CASE WHEN status BETWEEN 200 AND 399 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS island FROM l),
s AS (SELECT host, seq, CAST(sum(CASE WHEN status IN (403, 429, 503) THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i) SELECT host, seq, streak, streak >= 2 AS parked FROM s""")
def host_block_streak(spark, sf_dir):
    return crawl.block_streaks(_log(spark, sf_dir)).select("host", "seq", "streak", "parked")


# ---- answers and traces ----------------------------------------------------------------------------

@query("SELECT conv_id, count(*) AS steps, count(DISTINCT role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def trace_rollup(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"), F.countDistinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"), F.max_by("role", "turn").alias("last_role"))

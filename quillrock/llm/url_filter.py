"""URL filters with redirect equivalence: addresses that lead to one another share a block decision.

Every page's address, and every address that it names, is a node: host without letter case, path and query; scheme and
fragment make no difference. Edges are declared (a canonical link, a meta refresh, or rows of a redirect table) or
conventional: `www.`, a default port, a final slash and campaign parameters lead to the same address without them.
Connected components of this graph are found in rounds over written tables (simjoin.components). A component that
holds an address with a blocking rule passes the decision to its members; an address with a rule of its own, to allow
above all, keeps that rule's verdict. Anything else is allowed.

The page scan writes one slim row a page, without its html; no node's neighbours are gathered, and hot addresses are
split (common.split_join). Built-in functions only. A node's name is the 128-bit hash of its address.

Odd cases: a null address, or one without "://", has an empty host and path, fits no rule, is no node and is allowed;
null html names nothing; comments and scripts name nothing; repeated pages, ids and addresses are judged each; rules
of the same text that both block and allow, allow; of rules that fit the longest text decides, then the longer host;
addresses and pages of any length are taken whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolve
from .common import Scratch, split_join
from .simjoin import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path) of the corpus query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Query parameters that name a campaign, not a page.
CAMPAIGN = r"^(utm_[^=]*|gclid|fbclid)(=|$)"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of an address; all empty without a scheme."""
    pick = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", i), F.lit(""))
    return F.translate(pick(1), UPPER, LOWER), pick(2), pick(3)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, else null; the rules stand in the plan."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0] == "block"))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in reversed(ordered):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def _node(host: Column, path: Column, query: Column) -> Column:
    """The name of an address; null where there is none."""
    return F.when(host != "", F.md5(F.concat(host, path, query)))


def conventional(host: Column, path: Column, query: Column) -> tuple[Column, Column, Column]:
    """Where servers lead an address by convention."""
    kept = F.array_join(F.filter(F.split(F.substring(query, 2, 2**31 - 1), "&", -1), lambda p: ~p.rlike(CAMPAIGN)), "&")
    return F.regexp_replace(host, r"^www\.|:(80|443)?$", ""), F.regexp_replace(path, "/$", ""), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))


def _attribute(tag: Column, name: str) -> Column:
    """A tag's attribute in any quotes, or in none; "&amp;" is read as "&"."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.trim(F.regexp_replace(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))), "&amp;", "&"))


def declared(html: Column) -> Column:
    """array<string>: the references of a page's canonical links and meta refreshes."""
    seen = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    canonical = F.filter(F.regexp_extract_all(seen, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(F.regexp_extract_all(seen, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    to = F.transform(refresh, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['"]?([^'"]*)""", 1)))
    found = F.filter(F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), to), lambda x: x != "")
    return F.when(html.rlike("(?i)canonical|refresh"), found).otherwise(F.array().cast("array<string>"))


def _ends(url: Column, rules) -> Column:
    """struct(node, blocked) of an address."""
    host, path, query = parts(url)
    return F.struct(_node(host, path, query).alias("node"), F.coalesce(rule_of(host, path, rules)[1] == "block", F.lit(False)).alias("blocked"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule (null: none fits), verdict, via ('rule', 'alias' or 'default').

    redirects: (from_url, to_url) of a crawl's log, if there is one.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    host, path, query = parts(url)
    rule, verdict = rule_of(host, path, rules)
    usual = conventional(host, path, query)
    targets = F.transform(F.coalesce(declared(html), F.array().cast("array<string>")), lambda x: _ends(resolve(url, x), rules))
    to = F.concat(targets, F.array(F.struct(_node(*usual).alias("node"), F.coalesce(rule_of(*usual[:2], rules)[1] == "block", F.lit(False)).alias("blocked"))))
    to = F.array_distinct(F.filter(to, lambda x: x["node"].isNotNull() & (x["node"] != _node(host, path, query))))
    slim = scratch.table(
        pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("said"), _node(host, path, query).alias("node"), F.when(host != "", to).alias("to")),
        "slim",
    )
    own = F.coalesce(F.col("said") == "block", F.lit(False)).alias("ab")
    edges = slim.select(F.col("node").alias("a"), own, F.explode("to").alias("t")).select("a", "ab", F.col("t.node").alias("b"), F.col("t.blocked").alias("bb"))
    if redirects is not None:
        ends = redirects.select(_ends(F.col("from_url").cast("string"), rules).alias("x"), _ends(F.col("to_url").cast("string"), rules).alias("y"))
        edges = edges.unionByName(ends.where("x.node <> y.node").select(F.col("x.node").alias("a"), F.col("x.blocked").alias("ab"), F.col("y.node").alias("b"), F.col("y.blocked").alias("bb")))
    edges = scratch.table(edges.distinct(), "edges")
    labels = components(edges, scratch, "cc")
    marked = edges.where("ab").select(F.col("a").alias("sid")).unionByName(edges.where("bb").select(F.col("b").alias("sid"))).distinct()
    bad = scratch.table(labels.join(marked, "sid", "left_semi").select("comp").distinct(), "bad")
    blocked = scratch.table(split_join(labels, bad, "comp", F.col("sid")).select(F.col("sid").alias("node"), F.lit(True).alias("led")), "blocked")
    open_pages = F.col("said").isNull() & F.col("node").isNotNull()
    asked = split_join(slim.where(open_pages).select("page_id", "host", "path", "rule", "node"), blocked, "node", F.xxhash64("page_id", "path"), "left")
    led = F.coalesce("led", F.lit(False))
    judged = asked.select("page_id", "host", "path", "rule", F.when(led, "block").otherwise("allow").alias("verdict"), F.when(led, "alias").otherwise("default").alias("via"))
    ruled = slim.where(~open_pages).select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.when(F.col("said").isNull(), "default").otherwise("rule").alias("via"))
    return judged.unionByName(ruled)


# References are resolved without dot segments here; the tests hold those against the standard library.
ORACLE = r"""
WITH RECURSIVE links AS (
  SELECT page_id, url, html IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh') AS tagged, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>', '', 'g') AS h FROM pages),
refs AS (
  SELECT page_id, url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(h, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\srel\s*=\s*["'']?([^"''>]*\s)?canonical[\s"''>/]')),
      lambda t: trim(replace(regexp_extract(t, '(?is)\shref\s*=\s*["'']?([^"''\s>]*)', 1), '&amp;', '&'))),
    list_transform(list_filter(regexp_extract_all(h, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\shttp-equiv\s*=\s*["'']?refresh["''\s>]')),
      lambda t: trim(replace(regexp_extract(t, '(?is)\scontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[''"]?([^''"]*)', 1), '&amp;', '&'))))) AS ref
  FROM links WHERE tagged),
addresses AS (
  SELECT url AS base, url AS address FROM pages
  UNION
  SELECT url, CASE WHEN regexp_matches(ref, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN ref WHEN starts_with(ref, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || ref
    WHEN starts_with(ref, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || ref
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:]/)[^/]*$', '\1') || ref END FROM refs WHERE ref <> '' AND url IS NOT NULL),
cut AS (
  SELECT base, address, translate(regexp_extract(address, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(address, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(address, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query FROM addresses),
usual AS (
  SELECT *, regexp_replace(host, '^www\.|:(80|443)?$', '', 'g') AS host2, regexp_replace(path, '/$', '') AS path2,
    list_filter(string_split(substr(query, 2), '&'), lambda p: NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)')) AS args FROM cut),
rules(says, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
places AS (SELECT DISTINCT host, path FROM (SELECT host, path FROM usual UNION ALL SELECT host2, path2 FROM usual) WHERE host <> ''),
ruled AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(says, length(rh || rp)) AS said FROM places JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
nodes AS (
  SELECT base, address, host || path || query AS node, host2 || path2 || CASE WHEN array_to_string(args, '&') = '' THEN '' ELSE '?' || array_to_string(args, '&') END AS usual_node, host, path, host2, path2
  FROM usual WHERE host <> ''),
blocking AS (
  SELECT node FROM nodes JOIN ruled USING (host, path) WHERE said = 'block'
  UNION SELECT usual_node FROM nodes JOIN ruled r ON r.host = host2 AND r.path = path2 WHERE said = 'block'),
edges AS (
  SELECT node AS a, usual_node AS b FROM nodes n WHERE base = address
  UNION SELECT o.node, n.node FROM nodes n JOIN nodes o ON n.base = o.address AND o.base = o.address),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
led AS (SELECT node FROM blocking UNION SELECT both_ways.b FROM led JOIN both_ways ON led.node = both_ways.a),
own AS (SELECT DISTINCT base AS url, host, path, host || path || query AS node FROM usual WHERE base = address OR base IS NULL)
SELECT p.page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, r.rule,
  coalesce(r.said, CASE WHEN l.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN r.said IS NOT NULL THEN 'rule' WHEN l.node IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM pages p LEFT JOIN own o ON p.url IS NOT DISTINCT FROM o.url LEFT JOIN ruled r ON o.host = r.host AND o.path = r.path LEFT JOIN led l ON o.host <> '' AND o.node = l.node
"""

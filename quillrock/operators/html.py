"""Pages as tables: links, scores, tables, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import updated_in
from ..functions.fees import WRITTEN
from ..functions.text import audited_text, nfc, to_ascii_digits, visible_text
from ..functions.urls import resolve  # noqa: F401  resolve is part of what pages offer

#: Words that make a link worth following, and their weights (fixed values).
KEYWORDS = (
    ("fee", 5), ("fees", 5), ("ফি", 5), ("চার্জ", 4), ("মূল্য", 3), ("খরচ", 4), ("charter", 5), ("চার্টার", 5), ("সিটিজেন", 4), ("citizen", 3), ("সেবা", 4), ("service", 3), ("services", 3),
    ("আবেদন", 4), ("apply", 3), ("application", 3), ("নির্দেশিকা", 4), ("instruction", 3), ("guideline", 3), ("নিয়মাবলী", 4), ("প্রয়োজনীয়", 4), ("কাগজপত্র", 5), ("document", 3), ("required", 3), ("দলিল", 3),
    ("faq", 3), ("প্রশ্ন", 3), ("জিজ্ঞাসা", 3), ("form", 2), ("ফরম", 2), ("প্রজ্ঞাপন", 4), ("circular", 4), ("পরিপত্র", 4), ("gazette", 4), ("গেজেট", 4), ("notice", 2), ("বিজ্ঞপ্তি", 2),
    ("how", 2), ("process", 3), ("প্রক্রিয়া", 4), ("পদ্ধতি", 4),
)
#: Patterns of links and amounts in pages (fixed values).
LINK = r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
PAGE_AMOUNT = r"[\p{Nd}][\p{Nd},]{1,}\s*/?-?\s*(?:টাকা|টাকার)|TK\s*[\p{Nd},]+|BDT\s*[\p{Nd},]+"


def keyword_score(blob: Column, url: Column, keywords=KEYWORDS) -> Column:
    """Sum of the weights of the words present (a word inside another counts too), 3 more for a PDF."""
    total = F.lit(0)
    for word, weight in keywords:
        total = total + F.when(blob.contains(word), weight).otherwise(0)
    return (total + F.when(F.lower(url).endswith(".pdf"), 3).otherwise(0)).cast("int")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, href, label) of the links of each page; in-page and script links are dropped."""
    found = pages.select(url, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(LINK), 0)).alias("pos", "tag"))
    out = found.select(url, "pos", F.regexp_extract("tag", LINK, 1).alias("href"), F.left(visible_text(F.regexp_extract("tag", LINK, 2)), F.lit(90)).alias("label"))
    return out.where(~F.col("href").rlike("^(?:#|javascript:|mailto:|tel:)"))


def best_links(scored: DataFrame) -> DataFrame:
    """(page, target, score, label): per target the best score, then the longest label, then the first."""
    best = F.max_by(F.struct("score", "label"), F.struct("score", F.length("label"), -F.col("pos")))
    return scored.where("score > 0").groupBy("url", "target").agg(best.alias("b")).select("url", "target", F.col("b.score").alias("score"), F.col("b.label").alias("label"))


def tables(html: Column) -> Column:
    """array<array<array<string>>>: tables, rows with a filled cell, cells as visible text."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), visible_text)
    rows = lambda table: F.filter(F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), cells), lambda r: F.exists(r, lambda c: c != ""))
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1), rows), lambda t: F.size(t) > 0)


def page_facts(pages: DataFrame) -> DataFrame:
    """(url, updated, amounts, text_sha1, chars): what two visits to a page are compared by. Text is NFC; zero is no amount."""
    t = pages.select("url", visible_text(F.col("html")).alias("t")).select("url", nfc(F.col("t")).alias("t"))
    n = lambda x: F.regexp_replace(to_ascii_digits(x), "[^0-9]", "").try_cast("long")
    amounts = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("t", F.lit(PAGE_AMOUNT), 0), n), lambda x: x > 0)))
    return t.select("url", updated_in(F.col("t")).alias("updated"), amounts.alias("amounts"), F.sha1("t").alias("text_sha1"), F.length("t").alias("chars"))


def followed(links: DataFrame, suffix: str = ".gov.bd") -> DataFrame:
    """Of resolved links (url, target) those worth a visit: over http(s), and on the page's host, on a host of `suffix`, or a PDF by the address's end."""
    to = host(F.col("target"))
    return links.where(F.col("target").rlike("(?i)^https?://") & ((to == host(F.col("url"))) | to.endswith(suffix) | F.lower("target").endswith(".pdf")))


def is_pdf(url: Column) -> Column:
    """By the path's ending; a query or fragment does not hide it."""
    return F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".pdf")


def in_order(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc("label"), F.desc("target"))


def link_preview(scored: DataFrame, n: int = 25, chars: int = 70) -> DataFrame:
    """Per page the n best links (score, label, target, each descending), labels cut: what a reader is shown."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", "label", "target")), asc=False), 1, n)
    return scored.groupBy("url").agg(best.alias("links")).select("url", F.transform("links", lambda x: x.withField("label", F.left(x["label"], F.lit(chars)))).alias("links"))


def table_preview(html: Column, most: tuple[int, int, int] = (3, 12, 6), chars: int = 120) -> Column:
    """The first tables of two rows or more: rows of cut cells with the addresses that the row links to."""
    n_tables, n_rows, n_cells = most
    cell = lambda x: F.left(visible_text(x), F.lit(chars))
    row = lambda r: F.struct(
        F.slice(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), cell), 1, n_cells).alias("cells"),
        F.regexp_extract_all(r, F.lit(r"""(?is)href=["']([^"']+)["']"""), 1).alias("links"),
    )
    rows = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), row), lambda r: F.exists(r["cells"], lambda c: c != ""))
    found = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1), rows), lambda t: F.size(t) >= 2)
    return F.slice(F.transform(found, lambda t: F.slice(t, 1, n_rows)), 1, n_tables)


def signals(pages: DataFrame, least: int = 400) -> DataFrame:
    """What one look at each page says of its source, of pages (page_id, url, html) and, if there, final_url and content_type.

    (page_id, title, visible_chars, bengali_chars, likely_js, login_wall, redirected, n_pdf, pdfs): text is counted of text bodies only, percent
    codes decoded; only HTML can be a script's shell; a password input makes a login wall; PDFs are links with ".pdf" in
    them, once each, resolved; a redirect is another address than the asked one but for a final slash.
    """
    has = set(pages.columns)
    final = F.coalesce(F.col("final_url"), F.col("url")) if "final_url" in has else F.col("url")
    kind = F.trim(F.lower(F.split(F.coalesce("content_type", F.lit("")), ";")[0])) if "content_type" in has else F.lit("text/html")
    t = F.when(kind.startswith("text/"), audited_text(F.col("html"))).otherwise("")
    found = F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"']+?\.pdf[^"']*)["']"""), 1)
    seen = pages.select("page_id", "url", final.alias("final"), kind.alias("kind"), "html", F.coalesce(t, F.lit("")).alias("t"), F.array_sort(F.array_distinct(F.transform(found, lambda x: resolve(final, x)))).alias("pdfs"))
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    return seen.select(
        "page_id", F.left(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(160)).alias("title"), F.length("t").cast("long").alias("visible_chars"), F.regexp_count("t", F.lit("[\u0980-\u09ff]")).cast("long").alias("bengali_chars"),
        (F.col("kind").startswith("text/html") & (F.length("t") < least)).alias("likely_js"), F.col("html").rlike(r"""(?i)<input[^>]+type=["']?password""").alias("login_wall"),
        (bare(F.col("final")) != bare(F.col("url"))).alias("redirected"), F.size("pdfs").cast("long").alias("n_pdf"), "pdfs",
    )


def kind_of(content_type: Column, url: Column) -> Column:
    """How a body is to be read: 'pdf', 'html' or 'other'."""
    c = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(c.contains("pdf") | is_pdf(url), "pdf").when(c.contains("html") | (c == ""), "html").otherwise("other")


def fee_strings(text: Column, pattern: str = WRITTEN, before: int = 35, after: int = 35) -> Column:
    """array<struct<amount, context>>: amounts as written, once each in order of first sight, with the text about the first."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
    begin = lambda x: F.greatest(F.instr(text, x) - before, F.lit(1))
    return F.transform(found, lambda x: F.struct(x.alias("amount"), F.substring(text, begin(x), F.instr(text, x) - begin(x) + F.length(x) + after).alias("context")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))

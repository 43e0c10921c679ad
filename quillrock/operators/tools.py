"""The agent's tools as tables: every call of a batch answered in one plan, and the tools as views for SQL.

A call is a row (call_id, tool, args). Each tool is a projection of what a fetch gives (pages, bodies), joined with its
calls by address; an unknown tool, missing or odd arguments, and an address without a body are answers too. No call
runs a job of its own, and a call is answered once however often its address is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fonts
from ..functions.fees import parse_fees
from ..functions.text import clip, nfc, visible_text
from . import html

SHOWN = 4000
#: Tools, what they are for, their arguments and whether these must be there.
TOOLS = {
    "discover_links": ("Links of a page, scored by words of services and fees.", {"url": True}),
    "fetch_page": ("A page's visible text and its own date of update.", {"url": True}),
    "extract_tables": ("The tables of a page as rows of cells with their links.", {"url": True}),
    "detect_pdf": ("The encoding of a document, before any of its text is trusted.", {"url": True}),
    "decode_pdf": ("A document's lines, or those that hold a text.", {"url": True, "contains": False}),
    "parse_fee": ("The amounts of a fee cell; the only way to a number.", {"text": True}),
}


def schemas() -> list[dict]:
    """JSON schemas of all tools."""
    shape = lambda args: {"type": "object", "properties": {a: {"type": "string"} for a in args}, "required": [a for a, must in args.items() if must]}
    return [{"name": n, "description": about, "parameters": shape(args)} for n, (about, args) in TOOLS.items()]


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def link_tool(pages: DataFrame, keywords=html.KEYWORDS, suffix: str = ".gov.bd", most: int = 25) -> DataFrame:
    """(url, links) of every page; a page without links has none."""
    found = html.links(pages).withColumn("target", html.resolve(F.col("url"), F.col("href")))
    scored = html.followed(found, suffix).withColumn("score", html.keyword_score(F.lower(F.concat_ws(" ", "label", "target")), F.col("target"), keywords))
    shown = html.link_preview(html.best_links(scored), most)
    return pages.select("url").join(shown, "url", "left").select("url", F.coalesce("links", F.array().cast(shown.schema["links"].dataType)).alias("links"))


def page_tool(pages: DataFrame) -> DataFrame:
    """(url, updated, text): NFC, cut with a mark."""
    t = pages.select("url", nfc(visible_text(F.coalesce("html", F.lit("")))).alias("t"))
    return t.select("url", dates.updated_in(F.col("t")).alias("updated"), clip(F.col("t"), SHOWN).alias("text"))


def table_tool(pages: DataFrame) -> DataFrame:
    """(url, n_tables, preview): links resolved, two a row."""
    preview = F.transform(html.table_preview(F.coalesce("html", F.lit("")), chars=80), lambda t: F.transform(t, lambda r: r.withField("links", F.slice(F.transform(r["links"], lambda x: html.resolve(F.col("url"), x)), 1, 2))))
    n = F.size(F.filter(html.tables(F.coalesce("html", F.lit(""))), lambda t: F.size(t) >= 2))
    return pages.select("url", n.alias("n_tables"), preview.alias("preview"))


def document_tool(bodies: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """(url, encoding, refused, lines) of bodies (url, text, is_pdf, corrected)."""
    read = fonts.routed(bodies, table or {}, "text", "is_pdf", "corrected")
    lines = F.filter(F.transform(F.split(F.coalesce("decoded", F.lit("")), "\n"), F.trim), lambda x: x != "")
    return read.select("url", "encoding", F.col("decoded").isNull().alias("refused"), lines.alias("lines"))


def answer(calls: DataFrame, pages: DataFrame, bodies: DataFrame, table: dict[str, str] | None = None, **links) -> DataFrame:
    """(call_id, tool, ok, error, result) of calls (call_id, tool, args map<string,string>), a row each; a result is JSON.

    pages (url, html) and bodies (url, text, is_pdf, corrected) by distinct addresses.
    """
    args = F.coalesce("args", F.create_map().cast("map<string,string>"))
    known, odd = F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, (_, wanted) in TOOLS.items():
        must = F.array(*(F.lit(a) for a, needed in wanted.items() if needed))
        missing = F.filter(must, lambda a: F.try_element_at(F.col("args"), a).isNull())
        extra = F.array_except(F.map_keys("args"), F.array(*map(F.lit, wanted)))
        known, odd = F.when(F.col("tool") == name, name).otherwise(known), F.when(F.col("tool") == name, F.array_sort(F.array_distinct(F.concat(missing, extra)))).otherwise(odd)
    given = calls.select("call_id", "tool", args.alias("args")).select("call_id", "tool", "args", known.alias("known"), odd.alias("odd"))
    wrong = F.when(F.col("known").isNull(), F.concat(F.lit("unknown tool "), F.coalesce("tool", F.lit("")), F.lit("; known: " + ", ".join(TOOLS)))).when(F.size("odd") > 0, F.concat("tool", F.lit(": wrong or missing arguments "), F.array_join("odd", ", ")))
    none = F.lit(None).cast("string")
    row = lambda df, error, result: df.select("call_id", "tool", error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), result).alias("result"))
    refused = row(given.where(wrong.isNotNull()), wrong, none)
    good = given.where(wrong.isNull()).select("call_id", "tool", F.col("args")["url"].alias("url"), F.col("args")["text"].alias("cell"), F.col("args")["contains"].alias("contains"))

    def of(names: tuple[str, ...], source: DataFrame, project, result: Column, error: Column | None = None) -> DataFrame:
        mine = good.where(F.col("tool").isin(*names))
        # only what is asked for is looked at
        asked = source.join(mine.select("url").distinct(), "url", "left_semi")
        j = mine.join(project(asked).withColumn("__there", F.lit(True)), "url", "left")
        gone = F.when(F.col("__there").isNull(), F.concat(F.lit("nothing is known of "), "url"))
        return row(j, gone if error is None else F.coalesce(gone, error), result)

    picked = F.when(F.col("contains").isNull(), F.slice("lines", 1, 120)).otherwise(F.filter("lines", lambda x: F.contains(x, F.col("contains"))))
    not_read = F.when(F.col("refused"), F.concat(F.lit("refused: "), "encoding"))
    # both tools of documents are answered by one reading of them
    detected = _json(url=F.col("url"), encoding=F.col("encoding"))
    decoded = _json(url=F.col("url"), total_lines=F.size("lines"), unusable_lines=F.size(F.filter("lines", fonts.unmapped)), matched=F.size(picked), lines=clip(F.array_join(picked, "\n"), SHOWN))
    fee = parse_fees(F.col("cell"))
    out = refused
    for more in (
        of(("discover_links",), pages, lambda p: link_tool(p, **links), _json(url=F.col("url"), links=F.col("links"))),
        of(("fetch_page",), pages, page_tool, _json(url=F.col("url"), updated=F.col("updated"), text=F.col("text"))),
        of(("extract_tables",), pages, table_tool, _json(url=F.col("url"), tables=F.col("n_tables"), preview=F.col("preview"))),
        of(("detect_pdf", "decode_pdf"), bodies, lambda x: document_tool(x, table), F.when(F.col("tool") == "detect_pdf", detected).otherwise(decoded), F.when(F.col("tool") == "decode_pdf", not_read)),
        row(good.where("tool = 'parse_fee'"), none, _json(input=F.left("cell", F.lit(400)), fees=fee["fees"], refused=fee["note"])),
    ):
        out = out.unionByName(more)
    return out


def register(spark: SparkSession, pages: DataFrame, bodies: DataFrame, table: dict[str, str] | None = None, **links) -> None:
    """The tools as views (tool_discover_links, ...) by address, and `parse_fee`'s cells as view tool_parse_fee of body lines.

    A filter on url reaches the scan below; other columns of pages are never read.
    """
    link_tool(pages, **links).createOrReplaceTempView("tool_discover_links")
    page_tool(pages).createOrReplaceTempView("tool_fetch_page")
    table_tool(pages).createOrReplaceTempView("tool_extract_tables")
    read = document_tool(bodies, table)
    read.select("url", "encoding").createOrReplaceTempView("tool_detect_pdf")
    read.select("url", "refused", F.posexplode_outer("lines").alias("line_no", "line")).createOrReplaceTempView("tool_decode_pdf")
    lines = read.select("url", F.posexplode("lines").alias("line_no", "line"))
    lines.select("url", "line_no", "line", parse_fees(F.col("line")).alias("p")).select("url", "line_no", "line", "p.fees", F.col("p.note").alias("refused")).createOrReplaceTempView("tool_parse_fee")

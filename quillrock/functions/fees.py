"""Conservative reading of fee cells and numbered lists: an ambiguous amount is no amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, to_ascii_digits

#: Patterns of fee cells (fixed values).
AMOUNT = r"([\p{Nd}][\p{Nd},\.]*)\s*/?-?\s*(?:টাকা|টাকার)"
FREE = r"বিনামূল্যে|বিনা\s*ফিস"
AMBIGUOUS = r"ভাগের|শতাংশ|ভিত্তি করে|কিস্তি|নির্ধারণ করা|ফি[^।\[]{0,20}তালিকা|অথবা\s*\(ii\)"
#: Amounts as other sources write them: lines of swept documents, cells and text of pages, recognised scans (fixed patterns).
SWEPT = r"[\p{Nd}][\p{Nd},]*\s*/?-?\s*(?:টাকা|টাকার)"
WRITTEN = r"(?i)[\p{Nd}][\p{Nd},\.]*\s*(?:/-)?\s*(?:টাকা|টাকার|BDT|Tk\.?|৳)|(?:টাকা|BDT|Tk\.?|৳)\s*[\p{Nd}][\p{Nd},\.]*"
SCANNED = r"[\p{Nd}][\p{Nd},]{1,}"
#: A list's marker in any place, in brackets or before one (fixed pattern).
ANY_MARKER = r"\(?[\p{Nd}]{1,2}\)"
LABEL = r"\((?:[কখগঘঙচছজ]|[ivx]+)\)|(?<=\s)[কখগঘঙচছজ]\)"


def whole(c: Column) -> Column:
    """Integer part of an amount: commas dropped, cut at the decimal point."""
    return F.get(F.split(F.replace(to_ascii_digits(c), F.lit(","), F.lit("")), r"\."), F.lit(0)).try_cast("long")


def parse_fees(c: Column) -> Column:
    """Struct (fees array<struct<amount, label, vat, method>>, outcome, note) of one cell.

    VAT: a part that says it is included has it; a percentage anywhere in the cell says it is not; else unknown.
    """
    return once(squeeze(c), lambda clean: once(F.trim(F.regexp_replace(clean, r"\[[^\]]*\]", " ")), lambda t: once(F.transform(F.regexp_extract_all(t, F.lit(AMOUNT), 1), whole), lambda hits: _read(clean, t, hits))))


def once(c: Column, f) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _read(clean: Column, t: Column, hits: Column) -> Column:
    n = F.size(hits)
    parts = F.filter(F.split(t, LABEL), lambda p: p.rlike(AMOUNT))
    extra = t.rlike(r"\p{Nd}+\s*%\s*ভ্যাট")
    within = lambda p: p.contains("ভ্যাটসহ") | p.contains("ভ্যাট সহ")
    fee = lambda amount, label, vat, method: F.struct(amount.cast("long").alias("amount"), label.alias("label"), vat.alias("vat"), F.lit(method).alias("method"))
    outcome = (
        F.when(F.coalesce(clean, F.lit("")) == "", "empty").when(t.rlike(FREE) & (n == 0), "free").when(n == 0, "no_amount").when(t.rlike(AMBIGUOUS), "ambiguous")
        .when(n == 1, "single").when(F.size(parts) == n, "split").otherwise("not_split")
    )
    return once(outcome, lambda outcome: _told(t, hits, parts, extra, within, fee, outcome))


def _told(t: Column, hits: Column, parts: Column, extra: Column, within, fee, outcome: Column) -> Column:
    fees = (
        F.when(outcome == "free", F.array(fee(F.lit(0), F.lit("বিনামূল্যে"), F.lit(True), "free of charge")))
        .when(outcome == "single", F.array(fee(hits[0], F.left(t, F.lit(180)), F.when(within(t), True).when(extra, False), "one amount")))
        .when(outcome == "split", F.transform(parts, lambda p: fee(whole(F.regexp_extract(p, AMOUNT, 1)), F.left(F.trim(p), F.lit(180)), F.when(p.contains("ভ্যাটসহ"), True).when(extra, False), "labelled part")))
        .otherwise(F.array().cast("array<struct<amount:bigint,label:string,vat:boolean,method:string>>"))
    )
    note = F.when(outcome == "empty", "empty fee cell").when(outcome == "no_amount", "no amount in cell").when(outcome == "ambiguous", "conditional amounts").when(outcome == "not_split", "amounts cannot be told apart")
    return F.struct(fees.alias("fees"), outcome.alias("outcome"), note.alias("note"))


def parse_fee_cell(c: Column) -> Column:
    """Struct (amounts array<bigint>, vats array<boolean>, outcome): the figures of `parse_fees`."""
    return once(parse_fees(c), lambda read: F.struct(F.transform(read["fees"], lambda f: f["amount"]).alias("amounts"), F.transform(read["fees"], lambda f: f["vat"]).alias("vats"), read["outcome"].alias("outcome")))


def split_numbered(c: Column, marker: str = r"(?:^|(?<=[\s;।]))[০-৯]{1,2}\)", least: int = 12) -> Column:
    """Items of a numbered list; a marker counts only if it is the next number expected.

    The text is cut at every marker; a fold over the pieces opens an item at the expected number and
    otherwise gives the piece back to the item before.
    """
    t = squeeze(c)
    pieces = F.arrays_zip(F.split(t, marker, -1).alias("p"), F.concat(F.array(F.lit("")), F.regexp_extract_all(t, F.lit(marker), 0)).alias("m"))
    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        number = F.regexp_extract(to_ascii_digits(x["m"]), r"(\d+)", 1).try_cast("int")
        opens = F.coalesce(number == a["next"], F.lit(False))
        piece = F.concat(x["m"], x["p"])
        closed = F.when(a["next"] > 1, F.concat(a["done"], F.array(F.trim(a["open"])))).otherwise(a["done"])
        return F.struct(
            F.when(opens, a["next"] + 1).otherwise(a["next"]).alias("next"),
            F.when(opens, closed).otherwise(a["done"]).alias("done"),
            F.when(opens, piece).otherwise(F.concat(a["open"], piece)).alias("open"),
        )

    return F.aggregate(
        pieces, zero, step,
        lambda a: F.filter(F.when(a["next"] > 1, F.concat(a["done"], F.array(F.trim(a["open"])))).when(t != "", F.array(t)).otherwise(a["done"]), lambda x: (F.length(x) > least) | (a["next"] == 1)),
    )


def split_docs(c: Column, least: int = 12, most: int = 400) -> Column:
    """Items of a list whose numbers may stand anywhere; items of more than `least` characters, cut at `most`."""
    return F.transform(F.filter(split_numbered(c, ANY_MARKER, least), lambda x: F.length(x) > least), lambda x: F.left(x, F.lit(most)))

"""Text columns: normalisation, visible text of HTML, digits, number sets, slugs."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .urls import unquote

BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
#: Decoded in this order, so "&amp;lt;" ends as "<" (fixed values).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _class(points: set[int]) -> str:
    """A set of code points as ranges of a pattern."""
    out, last = [], None
    for p in sorted(points):
        if last is not None and p == last + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
        last = p
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


@cache
def _unsettled() -> str:
    """Pattern of all that NFC may change: points that it replaces, marks that compose or stand in rows, starters behind what they compose with."""
    replaced, marks, firsts, starters, composing = set(), set(), set(range(0x1100, 0x1113)), set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)), set()
    firsts |= set(range(0xAC00, 0xD7A4, 28))
    for p in range(0xC0, 0x110000):
        c = chr(p)
        if unicodedata.combining(c):
            marks.add(p)
        parts = unicodedata.decomposition(c)
        if not parts or parts.startswith("<"):
            continue
        if not unicodedata.is_normalized("NFC", c):
            replaced.add(p)
            continue
        first, second = (int(x, 16) for x in parts.split())
        if unicodedata.combining(chr(second)):
            composing.add(second)
        else:
            firsts.add(first)
            starters.add(second)
    high = "[\\x{300}-\\x{10ffff}&&"
    return f"{high}{_class(replaced | composing)}]|{high}{_class(firsts | replaced)}]{_class(starters)}|{high}{_class(marks)}]{_class(marks)}"


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no function for it. Only texts that it may change meet Python. Apply once, at a scan, to a column of its own."""
    return F.coalesce(_composed(F.when(c.rlike(_unsettled()), c)), c)


def squeeze(c: Column) -> Column:
    """White space (Unicode) to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    """Form in which queries and aliases are compared."""
    return nfc(squeeze(F.lower(c)))


def replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def untagged(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]+>", " ")


def visible_text(html: Column) -> Column:
    """Text of a page without scripts and tags; NFC is left to the scan."""
    return squeeze(replace_all(untagged(html), ENTITIES))


def audited_text(html: Column) -> Column:
    """The same with percent codes decoded, as an audit counts it."""
    return squeeze(replace_all(unquote(untagged(html)), ENTITIES))


def to_ascii_digits(c: Column) -> Column:
    return F.translate(c, BENGALI_DIGITS, "0123456789")


def to_bengali_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", BENGALI_DIGITS)


def number_set(c: Column) -> Column:
    """Distinct numbers as written, without thousands commas and leading zeros; Bengali digits become ASCII first."""
    found = F.regexp_extract_all(to_ascii_digits(c), F.lit(r"(\p{Nd}[\p{Nd},]*)"), 1)
    bare = F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), "^0+(?=.)", ""))
    return F.array_sort(F.array_distinct(bare))


def slug(url: Column) -> Column:
    """File name of a cached page: cleaned path and the head of a hash."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.left(path, F.lit(80)), F.lit("_"), F.left(F.sha1(url), F.lit(8)))


def clip(c: Column, n: int, mark: str = " …") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("long")


def filled(*cols: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))

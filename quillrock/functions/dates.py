"""Dates in Bengali text, ages, and how fresh a record is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import to_ascii_digits, to_bengali_digits

STALE_DAYS = 90
#: Months as sources spell them (fixed values).
MONTHS = (
    ("জানুয়ারী", 1), ("জানুয়ারি", 1), ("ফেব্রুয়ারী", 2), ("ফেব্রুয়ারি", 2), ("মার্চ", 3), ("এপ্রিল", 4), ("মে", 5), ("জুন", 6),
    ("জুলাই", 7), ("আগস্ট", 8), ("আগষ্ট", 8), ("সেপ্টেম্বর", 9), ("অক্টোবর", 10), ("নভেম্বর", 11), ("ডিসেম্বর", 12),
)
#: Update marks of pages (fixed patterns).
FOOTER = r"হাল[\s​‌‍-]*নাগাদ[^:]*:\s*([^\n]{0,60}?)(?:\s+এ\s|$)"
MARKER = r"Last updated[:\s]*([০-৯0-9]{1,2}\s+\S+\s+[০-৯0-9]{4})"


def bengali_date(c: Column) -> Column:
    """Date of 'day month year' text; null for an unknown month or an impossible day.

    A month counts if it is spelt as known, else by its first four characters, first match first.
    """
    pattern = r"(\d{1,2})\s*,?\s*([^\s,]+)\s*,?\s*(\d{4})"
    t = to_ascii_digits(c)
    name = F.regexp_extract(t, pattern, 2)
    exact, loose = F.lit(None).cast("int"), F.lit(None).cast("int")
    for spelt, number in reversed(MONTHS):
        exact = F.when(name == spelt, number).otherwise(exact)
        loose = F.when(name.startswith(spelt[:4]), number).otherwise(loose)
    month = F.when(name != "", F.coalesce(exact, loose))
    iso = F.format_string("%04d-%02d-%02d", F.regexp_extract(t, pattern, 3).try_cast("int"), month, F.regexp_extract(t, pattern, 1).try_cast("int"))
    return F.when(month.isNotNull(), F.try_to_date(iso, "yyyy-MM-dd"))


def staleness(c: Column) -> Column:
    """Struct (date, raw, kind) of a page's own update mark: the site's footer, else a mark in the content."""
    footer, marker = F.regexp_extract(c, FOOTER, 1), F.regexp_extract(c, MARKER, 1)
    has_footer, has_marker = c.rlike(FOOTER), c.rlike(MARKER)
    raw = F.trim(F.when(has_footer, footer).when(has_marker, marker))
    kind = F.when(has_footer, "cms_footer").when(has_marker, "content_marker")
    return F.struct(bengali_date(raw).alias("updated"), raw.alias("raw"), kind.alias("kind"))


def age_days(d: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), d)


#: "days ago", "about", "years" in Bengali (fixed values).
AGO, ABOUT, YEARS = "দিন আগে", "প্রায়", "বছর"


def age_text(days: Column, lang: str = "en") -> Column:
    """How long ago, in words of a reader's language: days, from a year on years and days."""
    if lang == "bn":
        n = lambda c: to_bengali_digits(c.cast("string"))
        return F.when(days < 365, F.concat(n(days), F.lit(f" {AGO}"))).otherwise(F.concat(F.lit(f"{ABOUT} "), n(F.floor(days / 365)), F.lit(f" {YEARS}, "), n(days % 365), F.lit(f" {AGO}")))
    years, rest = F.floor(days / 365).cast("string"), (days % 365).cast("string")
    plural = F.when(days >= 730, "s").otherwise("")
    return F.when(days < 365, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.lit("about "), years, F.lit(" year"), plural, F.lit(", "), rest, F.lit(" days ago")))


def freshness(age: Column, worst_fee_age: Column, status: Column, exists: Column) -> Column:
    """Level of a record. Unverified outweighs a stale fee, which outweighs the record's own age."""
    own = F.when(age.isNull(), "unknown").when(age > STALE_DAYS, "stale").otherwise("fresh")
    return F.when(~exists, "none").when(status == "unverified", "unverified").when(worst_fee_age > STALE_DAYS, "stale").otherwise(own)


def updated_in(text: Column) -> Column:
    """The date of a page's own update mark, or null."""
    return staleness(text)["updated"]

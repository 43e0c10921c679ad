"""Which language to answer in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Romanised function words; nouns say nothing (fixed values).
ROMANISED = (
    "koto", "kivabe", "kibhabe", "ki", "kise", "kothay", "kothae", "kobe", "keno", "lage", "lagbe", "korte", "korbo", "kora", "korar", "kore", "ami",
    "amar", "amake", "amader", "apni", "apnar", "tar", "tara", "taka", "tk", "hobe", "hoy", "hoyni", "hoye", "geche", "gele", "chai", "chaile",
    "dorkar", "proyojon", "nite", "pabo", "paoa", "jabo", "jete", "ache", "nei", "jonno", "jonne", "ekta", "akta", "kono", "shob", "kaj", "din",
    "bochor", "bochhor", "bhul", "thik", "kagoj", "kagojpotro", "sonod", "nibondhon", "khulte", "tulte",
)


def romanised_hits(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)
    return F.size(F.filter(words, lambda w: w.isin(*ROMANISED)))


def detect(c: Column) -> Column:
    """'bn' by script, or by two romanised words, or by one in a query of at most four; else 'en'."""
    words = F.size(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))
    hits = romanised_hits(c)
    romanised = (hits >= 2) | ((hits == 1) & (words <= 4))
    return F.when(c.rlike("[ঀ-৿]"), "bn").when(romanised, "bn").otherwise("en")


def pick(labels: Column, lang: Column) -> Column:
    """Label of a map by language, English where it is missing or empty."""
    return F.coalesce(F.nullif(F.try_element_at(labels, lang), F.lit("")), F.try_element_at(labels, F.lit("en")))

"""Checks of answers: sections, grounding in the record, safety, wanted and forbidden phrases, scores.

An answer is Markdown whose sections begin with a heading line. Everything is per row: the record that an answer
was made from is joined by its category, and its documents and amounts are arrays beside the answer.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_ascii_digits

STRINGS = "array<string>"


def section(markdown: Column, heading: str) -> Column:
    """What stands under a heading line, up to the next heading or rule; empty where there is none."""
    return F.regexp_extract(markdown, rf"(?s)(?:^|\n)### {heading}\n(.*?)(?=\n### |\n---|\z)", 1)


def bullets(body: Column) -> Column:
    """Texts of the bullet lines; a placeholder in italics is none."""
    items = F.transform(F.filter(F.split(body, "\n"), lambda x: x.startswith("- ")), lambda x: F.trim(F.substr(x, F.lit(3))))
    return F.filter(items, lambda x: ~x.startswith("_"))


def has(markdown: Column, markers: list[str]) -> Column:
    """Whether any of a marker's spellings stands in the text, which is in NFC."""
    return F.exists(F.array(*(F.lit(unicodedata.normalize("NFC", m)) for m in markers)), lambda m: F.contains(markdown, m))


def table_amounts(body: Column, header: str, free: list[str], unverified: list[str]) -> Column:
    """Numbers in the second cell of each row of a fee table; free counts as 0, an unverified cell gives none."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith("|") & ~x.startswith("|---") & ~x.contains(header))
    cells = F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))
    second = F.transform(F.filter(cells, lambda c: F.size(c) >= 2), lambda c: F.trim(c[1]))
    says = lambda c, words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(c, w))
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long")
    read = lambda c: (
        F.when(says(c, free), F.array(F.lit(0).cast("long"))).when(says(c, unverified), F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.regexp_extract_all(to_ascii_digits(c), F.lit(r"([0-9][0-9,]*)"), 1), number))
    )
    return F.flatten(F.transform(second, read))


def ungrounded_amounts(printed: Column, known: Column) -> Column:
    """Printed amounts that the record does not have; without a record all of them."""
    return F.array_sort(F.array_except(printed, F.coalesce(known, F.array().cast("array<bigint>"))))


def ungrounded_documents(printed: Column, known: Column, head: int = 60) -> Column:
    """Printed documents of which no record document holds the head, nor the other way round."""
    docs = F.coalesce(known, F.array().cast(STRINGS))
    same = lambda x: F.exists(docs, lambda d: F.contains(d, F.left(x, F.lit(head))) | F.contains(x, F.left(d, F.lit(head))))
    return F.filter(printed, lambda x: ~same(x))


def safety_problems(answer: Column, status: Column, source_url: Column, fees: str, documents: str, dated: list[str]) -> Column:
    """Names of the broken rules: no fee table without a record or for an unverified one, no checklist for the latter,
    and the record's source and a word on its date always."""
    shows = lambda heading: F.contains(answer, F.lit(f"### {heading}"))
    listed = F.size(bullets(section(answer, documents))) > 0
    known, unverified = status.isNotNull(), F.coalesce(status == "unverified", F.lit(False))
    any_of = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(answer, w))
    rules = F.array(
        F.when(~known & shows(fees), "fees_without_record"),
        F.when(unverified & shows(fees), "fees_unverified"),
        F.when(unverified & listed, "documents_unverified"),
        F.when(known & ~F.coalesce(F.contains(answer, source_url), F.lit(False)), "source_missing"),
        F.when(known & ~any_of(dated), "date_missing"),
    )
    return F.filter(rules, lambda r: r.isNotNull())


def assertion_problems(answer: Column, wanted: Column, forbidden: Column) -> Column:
    """missing:... and forbidden:..., compared in lower case; all are in NFC (text.nfc). Null arrays ask for nothing."""
    text = F.lower(answer)
    none = F.array().cast(STRINGS)
    held = lambda w: F.contains(text, F.lower(w))
    missing = F.transform(F.filter(F.coalesce(wanted, none), lambda w: ~held(w)), lambda w: F.concat(F.lit("missing:"), w))
    present = F.transform(F.filter(F.coalesce(forbidden, none), held), lambda w: F.concat(F.lit("forbidden:"), w))
    return F.concat(missing, present)


def judged(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """questions (id, kind, expect_category) with answered (id, category, asserted, grounded, safe: arrays of problems): booleans a question.

    A question that was not answered fails in all.
    """
    j = questions.join(answered, "id", "left")
    passed = lambda c: F.coalesce(F.size(c) == 0, F.lit(False))
    return j.select("id", "kind", F.coalesce(F.col("category") == F.col("expect_category"), F.lit(False)).alias("intent_ok"), passed("asserted").alias("assert_ok"), passed("grounded").alias("ground_ok"), passed("safe").alias("safe_ok"))


def scores(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of `judged`, and the rate of answers that are not grounded, for all or by kind."""
    names = ("intent", "assert", "ground", "safe")
    sums = [F.sum(F.col(f"{c}_ok").cast("long")).alias(f"n_{c}") for c in names]
    got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    rate = lambda c: F.round(F.col(f"n_{c}") / F.col("n"), 4).alias(f"{c}_rate")
    return got.select(*by, "n", *(f"n_{c}" for c in names), *map(rate, names), F.round(1 - F.col("n_ground") / F.col("n"), 4).alias("hallucination_rate"))

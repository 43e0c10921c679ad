"""What changed between two snapshots of page facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per page of `after`: status 'new', 'changed', 'text' (no fact changed) or 'identical', and what changed.

    Facts (url, updated, amounts, text_sha1) are one row a page. A new page has nothing to be compared with.
    """
    was = before.select("url", F.col("updated").alias("was"), F.col("amounts").alias("a1"), F.col("text_sha1").alias("s1"), F.lit(True).alias("old"))
    j = after.join(was, "url", "left")
    none = F.array().cast("array<bigint>")
    removed, added = F.array_sort(F.array_except("a1", "amounts")), F.array_sort(F.array_except("amounts", "a1"))
    dated = F.col("old") & ~F.col("was").eqNullSafe(F.col("updated"))
    priced = F.col("old") & (F.size(removed) + F.size(added) > 0)
    status = F.when(F.col("old").isNull(), "new").when(dated | priced, "changed").when(~F.col("s1").eqNullSafe(F.col("text_sha1")), "text").otherwise("identical")
    return j.select(
        "url", status.alias("status"), F.coalesce(dated, F.lit(False)).alias("dated"), F.coalesce(priced, F.lit(False)).alias("priced"),
        "was", F.col("updated").alias("now"), F.coalesce(removed, none).alias("removed"), F.when(F.col("old"), added).otherwise(none).alias("added"),
    )


def findings(seen: DataFrame) -> DataFrame:
    """(url, kind, was, now, removed, added): a row for each changed fact of `compared`, 'source_date' and 'amounts'.

    New pages and pages of which only the text changed are no findings.
    """
    none, nothing = F.array().cast("array<bigint>"), F.lit(None).cast("date")
    row = lambda kind, was, now, removed, added: F.struct(F.lit(kind).alias("kind"), was.alias("was"), now.alias("now"), removed.alias("removed"), added.alias("added"))
    both = F.array(
        F.when(F.col("dated"), row("source_date", F.col("was"), F.col("now"), none, none)), F.when(F.col("priced"), row("amounts", nothing, nothing, F.col("removed"), F.col("added"))),
    )
    return seen.where("dated or priced").select("url", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("f")).select("url", "f.*")


def run_report(seen: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: pages checked, pages that could not be read, pages with findings, and pages by status."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    told = F.count_if(F.col("dated") | F.col("priced"))
    return seen.agg(F.count(F.lit(1)).alias("checked"), told.alias("findings"), *map(count, ("new", "changed", "text", "identical"))).crossJoin(errors.agg(F.count(F.lit(1)).alias("errors")))


def affected(changes: DataFrame, index: DataFrame) -> DataFrame:
    """Categories touched by findings, through (url, category)."""
    return changes.join(index, "url").groupBy("category").agg(F.countDistinct("url").alias("n_urls"))

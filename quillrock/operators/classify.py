"""Alias containment: which categories does a query name?"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot


#: Aliases that one automaton holds; more take another pass over the queries.
AUTOMATON = 200_000


def alias_hits(queries: DataFrame, aliases: DataFrame, word_boundary: bool = False) -> DataFrame:
    """queries (qid, norm) x aliases (category, alias, pos) -> qid, category, alias: the longest per category.

    The aliases are one automaton, sent to the tasks, that takes one pass over each query: no query meets an alias that it
    does not hold, and nothing is shuffled. Equal lengths: the earlier alias.
    """
    known = aliases.where("alias is not null and alias <> ''").select("category", "alias", F.col("pos").cast("long").alias("pos"))
    n, sc, found = max(1, -(-known.count() // AUTOMATON)), queries.sparkSession.sparkContext, None
    for i in range(n):
        # all aliases of a category go into one automaton, so its longest hit is known there
        part = known if n == 1 else known.where(F.pmod(F.xxhash64("category"), F.lit(n)) == i)
        sent = sc.broadcast([tuple(r) for r in part.collect()])

        def run(batches, sent=sent):
            import ahocorasick

            by: dict[str, list] = {}
            for category, alias, pos in sent.value:
                by.setdefault(f" {alias} " if word_boundary else alias, []).append((category, len(alias), -pos, alias))
            machine = ahocorasick.Automaton()
            for word, named in by.items():
                machine.add_word(word, named)
            machine.make_automaton()
            for b in batches if by else []:
                out = []
                for row, text in enumerate(b.column(1).to_pylist()):
                    best: dict = {}
                    seen = set()
                    for _, named in machine.iter(f" {text} " if word_boundary else text) if text else ():
                        if id(named) not in seen:
                            seen.add(id(named))
                            for category, *worth in named:
                                if category not in best or worth > best[category]:
                                    best[category] = worth
                    out += [(row, category, worth[2]) for category, worth in best.items()]
                if out:
                    rows, categories, words = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(categories), pa.array(words)], ["qid", "category", "alias"])

        got = queries.select("qid", "norm").mapInArrow(run, f"qid {queries.schema['qid'].dataType.simpleString()}, category {aliases.schema['category'].dataType.simpleString()}, alias string")
        found = got if found is None else found.unionByName(got)
    return found


def route(queries: DataFrame, hits: DataFrame, fallback: str = "unknown_service") -> DataFrame:
    """One row per query: how it is to be classified, by its number of categories."""
    per = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"), F.min("category").alias("only"))
    j = queries.select("qid").join(per, "qid", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("long"))
    return j.select("qid", "n_hits", F.when(F.col("n_hits") == 1, F.col("only")).otherwise(fallback).alias("category"), F.when(F.col("n_hits") == 1, "alias").when(F.col("n_hits") > 1, "alias+embedding").otherwise("embedding").alias("method"))


def resolve(queries: DataFrame, hits: DataFrame, profiles: DataFrame, floor: float = 0.8, margin: float = 0.015, fallback: str = "unknown_service") -> DataFrame:
    """One row per query: category, confidence, method, rationale.

    queries (qid, qvec); hits (qid, category, alias) as of alias_hits; profiles (category, pvec), a curated table of
    one row a category. One hit decides. Among several the most similar profile does. Without a hit the most similar
    profile must reach the floor and lead the next by the margin. Ties go to the lesser category.
    """
    per = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("category", "alias"))).alias("hit"))
    q = queries.join(per, "qid", "left").withColumn("names", F.coalesce(F.transform("hit", lambda h: h["category"]), F.array().cast("array<string>")))
    table = profiles.agg(F.collect_list(F.struct("category", "pvec")).alias("profiles"))
    asked = F.filter("profiles", lambda p: (F.size("names") == 0) | F.array_contains("names", p["category"]))
    scored = F.transform(asked, lambda p: F.struct((-F.round(dot(F.col("qvec"), p["pvec"]), 6)).alias("s"), p["category"].alias("category")))
    # one array of curated size beside each query that needs it
    ranked = q.where(F.size("names") != 1).crossJoin(F.broadcast(table)).withColumn("r", F.array_sort(scored))
    top, score = F.get("r", F.lit(0)), -F.get("r", F.lit(0))["s"]
    gap = F.round(score + F.get("r", F.lit(1))["s"], 6)
    several = F.size("names") > 1
    low, near = score < floor, F.coalesce(gap < margin, F.lit(False))
    by_vector = ranked.select(
        "qid", F.when(several | ~(low | near), top["category"]).otherwise(fallback).alias("category"), score.alias("confidence"),
        F.when(several, "alias+embedding").otherwise("embedding").alias("method"),
        F.when(several, F.concat(F.lit("aliases of "), F.array_join("names", ", "))).when(low, F.concat(F.lit("below floor: "), top["category"]))
        .when(near, F.concat(F.lit("ambiguous: "), top["category"], F.lit(", "), F.get("r", F.lit(1))["category"])).otherwise("nearest profile").alias("rationale"),
    )
    named = q.where(F.size("names") == 1).select("qid", F.col("names")[0].alias("category"), F.lit(1.0).cast("double").alias("confidence"), F.lit("alias").alias("method"), F.concat(F.lit("alias "), F.col("hit")[0]["alias"]).alias("rationale"))
    return named.unionByName(by_vector)


def outside(results: DataFrame, valid: DataFrame) -> DataFrame:
    """Results whose category is none of valid (id): what a classifier plugged in here must never give."""
    return results.join(valid.select(F.col("id").alias("category")), "category", "left_anti")


def answerable(results: DataFrame, fallbacks: tuple[str, ...] = ("unknown_service", "out_of_scope")) -> tuple[DataFrame, DataFrame]:
    """Results that go on to retrieval, and those that are answered without it."""
    short = F.col("category").isNull() | F.col("category").isin(*fallbacks)
    return results.where(~short), results.where(short)


def ambiguous(aliases: DataFrame) -> DataFrame:
    """(alias, n, n_categories) of aliases (category, alias) that stand more than once, in whatever case or blanks."""
    return aliases.groupBy(F.lower(F.trim("alias")).alias("alias")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("n_categories")).where("n > 1")

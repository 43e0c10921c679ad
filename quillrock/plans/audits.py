"""Queries of the audit, candidate and draft operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, html
from ..sources import sinks
from . import catalogue
from .registry import literal, query, table

@query(catalogue.LINK_SQL + """, b AS (SELECT url, pos, label, target, score + CASE WHEN contains(lower(label), 'th') THEN 10 ELSE 0 END AS score FROM s WHERE NOT contains(lower(label), 'que'))
SELECT url, CAST(pos AS INTEGER) AS pos, label, target, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY url ORDER BY score DESC, pos) AS INTEGER) AS rank FROM b QUALIFY rank <= 6""")
def link_candidates_top6(spark, sf_dir):
    return audit.top_candidates(catalogue._links(spark, sf_dir), "th", "que").select("url", "pos", "label", "target", "score", "rank")


@query("""SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches(text, '[0-9][0-9,]+')) AS n_with_amounts, count(*) FILTER (WHERE contains(text, '(cid:')) AS n_unusable FROM documents GROUP BY source""")
def swept_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("text").rlike("[0-9][0-9,]+")).alias("n_with_amounts"), F.count_if(F.col("text").contains("(cid:")).alias("n_unusable"))


@query("""SELECT count(*) AS checked, count(*) FILTER (WHERE html IS NULL OR html = '') AS errors, count(*) FILTER (WHERE page_id % 13 = 0) AS findings FROM pages""")
def run_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("html").isNull() | (F.col("html") == "")).alias("errors"), F.count_if(F.col("page_id") % 13 == 0).alias("findings"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(text), 'haus') OR regexp_matches(lower(text), 'fee|charge')""")
def rows_with_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = literal(spark, "('tion'), ('haus'), ('')", "term")
    return audit.named_rows(d, terms, "fee|charge").select(F.col("id").alias("doc_id"))


@query("""SELECT conv_id, role, text, min(turn) AS turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.turn = 0 AND s.conv_id = c.conv_id AND s.role = c.role AND s.text = c.text) GROUP BY conv_id, role, text""")
def frontier_unseen(spark, sf_dir):
    """Turns stand for actions; those of a conversation's first turn have been taken."""
    c = table(spark, sf_dir, "conversations")
    return audit.frontier(c, c.where("turn = 0"), ["conv_id", "role", "text"], "turn")


@query("""SELECT url, left(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9._-]+', '_', 'g'), 80) || '_' || left(sha1(url), 8) AS slug FROM pages""")
def url_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", text.slug(F.col("url")).alias("slug"))


@query("""SELECT p_brand AS id, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings""")
def embedding_norms(spark, sf_dir):
    from ..functions.vectors import dot

    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN left(text, 60) || ' …' ELSE text END AS observed, left(text, 20) AS head FROM conversations""")
def observation_clip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clip(F.col("text"), 60).alias("observed"), F.left("text", F.lit(20)).alias("head"))

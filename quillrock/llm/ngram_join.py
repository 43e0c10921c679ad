"""N-gram Jaccard join, size-aware heavy-light, and the components of its links.

Small sets enumerate all subsets of the size that the overlap bound demands; larger ones are found by
inverted lists of rare shingles; the boundary between them is chosen by cost (simjoin.choose_boundary).

Rows and odd cases: null ids keep a null component unless a linked document has one; null or empty texts
have no shingles, link with nothing and are their own component; rows that share an id are each listed
with the same rules; equal texts share a set and so a component; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_join
from .simjoin import Joined, components, whole


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))


def _hubs(long: DataFrame) -> DataFrame:
    """Sets with the most entries first: an original has more than its changed copies."""
    return long.groupBy("sid").agg((-F.count(F.lit(1))).alias("o"))


def links(joined: Joined, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b) links between distinct sets, enough to span every component; and the components.

    What hubs have joined comes first; candidate pairs are verified only between its components.
    """
    joined.rounds(_hubs)
    if not joined.near.limit(1).count():
        sure = joined.verified(joined.pairs, "links")
        return sure, components(sure, scratch, "cc")
    first = components(joined.near, scratch, "cc1")
    ends = split_join(joined.pairs, first.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), "a", F.col("b"), "left")
    ends = split_join(ends, first.select(F.col("sid").alias("b"), F.col("comp").alias("cb")), "b", F.col("a"), "left", counted=joined.pairs)
    open_pairs = scratch.table(ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "open")
    sure = scratch.table(joined.verified(open_pairs, "sure").unionByName(joined.near), "links")
    return sure, components(sure, scratch, "cc2")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, pct: int = 85, boundary: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable, itself included)."""
    scratch, units, full = _classes(docs, id_col, text_col, k, pct, boundary)
    least = full.groupBy("c").agg(F.min("id").alias("component_id"))
    done = split_join(full, least, "c", F.col("id")).select("id", "n", "component_id")
    empty = units.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return done.unionByName(empty).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, pct: int, boundary: int | None):
    """The units, and of those with words (id, h, n, c): c names the component."""
    scratch = Scratch(docs.sparkSession, "ngram")
    joined = Joined(_docs(docs, id_col, text_col), scratch, whole, k, pct, boundary=boundary)
    _, comp = links(joined, scratch)
    units = joined.units.select("id", "h", "n", "sid")
    full = split_join(units.where("n > 0"), comp, "sid", F.col("id"), "left").select("id", "h", "n", F.coalesce("comp", "sid").alias("c"))
    full = scratch.table(full, "classes")
    scratch.keep("units", "classes")
    return scratch, units, full


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, pct: int = 80) -> DataFrame:
    """Of the rows of each component one: of the least id (null ids last) and, of rows that share it, the least text hash.

    Rows equal in id and text count as one document, of which one stays. Documents without words are in no
    group and all stay.
    """
    _, _, full = _classes(docs, id_col, text_col, k, pct, None)
    first = full.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("f"))
    stay = first.select(F.col("f.id").alias("__qr_id"), F.col("f.h").alias("__qr_h"))
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    has = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # `stay` is one row a component: rows of an equal id and text are counted off by a number that only they share
    kept = docs.where(has).join(stay, ident.eqNullSafe(F.col("__qr_id")) & (F.xxhash64(text) == F.col("__qr_h")), "left_semi")
    twice = full.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__qr_id"), F.col("h").alias("__qr_h"))
    same = ident.eqNullSafe(F.col("__qr_id")) & (F.xxhash64(text) == F.col("__qr_h"))
    repeated = kept.join(twice, same, "left_semi").select(ident.alias("__qr_id"), F.xxhash64(text).alias("__qr_h"), F.struct(*[F.col(c) for c in docs.columns]).alias("__qr_row"))
    one = repeated.groupBy("__qr_id", "__qr_h").agg(F.first("__qr_row").alias("__qr_row")).select("__qr_row.*")
    return kept.join(twice, same, "left_anti").unionByName(one).unionByName(docs.where(~has))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
distinct_sets AS (SELECT row_number() OVER (ORDER BY doc_id) AS sid, s, doc_id FROM (SELECT list_sort(s) AS s, min(doc_id) AS doc_id FROM sets WHERE len(s) > 0 GROUP BY ALL)),
tok AS MATERIALIZED (SELECT sid, unnest(s) AS t, len(s) AS n FROM distinct_sets),
pairs AS MATERIALIZED (
  SELECT a.sid AS x, b.sid AS y FROM tok a JOIN tok b ON a.t = b.t AND a.sid <> b.sid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.sid, b.sid HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT sid AS x, sid AS y FROM distinct_sets UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
least_of AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN distinct_sets ON y = sid GROUP BY x)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN distinct_sets d ON list_sort(sets.s) = d.s LEFT JOIN least_of ON d.sid = least_of.x
"""

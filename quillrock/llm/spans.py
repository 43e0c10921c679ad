"""Positions of regular-expression matches with built-in functions only.

split() and regexp_extract_all() walk the same leftmost, non-overlapping matches, so lengths of the pieces
between matches and of the matches add up to positions, in code points.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], context: int = 0, marks: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Adds, per kind, a column `m_<kind>`: array of (m, start, before, after) of the pattern's matches.

    marks: per kind, strings of which every match holds one; a text without them is not searched. A text
    without a match is not split.

    before and after hold up to `context` characters next to the match, not reaching into other matches
    of the kind. Patterns must not match the empty string.
    """
    found, pieces = {}, {}
    for kind, pattern in patterns.items():
        every = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
        if marks and kind in marks:
            every = F.when(reduce(or_, [F.contains(F.col(text), F.lit(m)) for m in marks[kind]]), every)
        found[f"__m_{kind}"] = every
        pieces[f"__p_{kind}"] = F.when(F.size(f"__m_{kind}") > 0, F.split(F.col(text), pattern, -1))
    df = df.withColumns(found).withColumns(pieces)
    df = df.withColumns({f"__s_{kind}": _starts(kind) for kind in patterns})
    out = {f"m_{kind}": F.when(F.size(f"__m_{kind}") > 0, _matches(kind, context)) for kind in patterns}
    return df.withColumns(out).drop(*found, *pieces, *(f"__s_{kind}" for kind in patterns))


#: Starts that one growing string holds: it is copied at each match, so a full one is put aside.
BLOCK = 256


def _starts(kind: str) -> Column:
    """Starts of the matches as strings, and an empty one at the end; null without a match."""
    p, m = f"__p_{kind}", f"__m_{kind}"

    def step(a: Column, x: Column) -> Column:
        start, full = a["at"] + F.length(x[p]), a["k"] >= BLOCK
        more = F.when(x[m].isNull(), F.lit("")).otherwise(F.concat(start.cast("string"), F.lit(",")))
        return F.struct(
            (start + F.coalesce(F.length(x[m]), F.lit(0))).alias("at"),
            F.when(full, F.lit(1)).otherwise(a["k"] + 1).alias("k"),
            F.when(full, more).otherwise(F.concat(a["s"], more)).alias("s"),
            F.when(full, F.array_append(a["done"], a["s"])).otherwise(a["done"]).alias("done"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("k"), F.lit("").alias("s"), F.array().cast("array<string>").alias("done"))
    whole = F.aggregate(F.arrays_zip(p, m), zero, step, lambda a: F.concat(F.array_join(a["done"], ""), a["s"]))
    return F.when(F.size(m) > 0, F.split(whole, ","))


def _matches(kind: str, context: int) -> Column:
    p, m, s, n = f"__p_{kind}", f"__m_{kind}", f"__s_{kind}", f"__n_{kind}"
    columns = [F.col(m), F.col(s)]
    if context:  # the piece after a match is the next one
        columns += [F.col(p), F.slice(p, F.lit(2), F.size(p)).alias(n)]

    def shape(x: Column) -> Column:
        fields = [x[m].alias("m"), x[s].cast("long").alias("start")]
        if context:
            fields += [F.right(x[p], F.lit(context)).alias("before"), F.left(x[n], F.lit(context)).alias("after")]
        return F.struct(*fields)

    return F.transform(F.filter(F.arrays_zip(*columns), lambda x: x[m].isNotNull()), shape)


def joined(spans: Column) -> Column:
    """kind:start:end of an array of (start, rank, end, kind), by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def none_of(kind_struct: str) -> Column:
    return F.array().cast(f"array<{kind_struct}>")

"""Mixing sources to target weights by temperature.

Shares of tokens per source are raised to an exponent that a bisection finds: the lowest that keeps every
source within `max_epochs` repetitions, or the one whose weights have a target entropy. Weights become budgets
in tokens; a source's budget is realised as whole passes over its documents and, last, a partial pass: its
documents fall into `blocks` blocks by hash, blocks stand in a hashed order, and the pass takes blocks, and
in the last block documents, in that order until the budget is used. The total budget is the least that gives
every source one whole pass, so no document is dropped and small sources repeat.

Everything per source is one row, joined by broadcast only if Spark finds it small; per-document work is local,
and no task gathers a source: running sums go over at most `blocks` block totals, then over one block.

Odd cases: null text has no tokens and null sources are one source; documents without tokens are kept, once;
rows repeating an id share its place in the order; sources without tokens get whole passes; the result of an
empty table is empty; internal names start with __qr_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The default measure: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def _hash(*parts) -> Column:
    """A number in [0, 2**62)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


def exponent(totals: DataFrame, max_epochs: float | None, entropy: float | None, rounds: int = 5, grid: int = 32) -> float:
    """Bisection on a grid, `grid` parts a round: each round is one aggregate over all sources, one row a point.

    Epochs per source are n ** (a - 1) over the least such value. Repetition falls and entropy falls as the
    exponent rises from 0 (all sources alike) to 1 (as they are).
    """
    lo, hi = 0.0, 1.0
    n = F.col("__qr_total").cast("double")
    for _ in range(rounds):
        step = (hi - lo) / grid
        points = totals.where("__qr_total > 0").select(n.alias("n"), F.explode(F.array(*(F.lit(lo + step * i) for i in range(grid + 1)))).alias("a"))
        if entropy is None:
            spread = F.max(F.pow("n", F.col("a") - 1)) / F.min(F.pow("n", F.col("a") - 1))
            ok = {r["a"]: r["x"] <= max_epochs for r in points.groupBy("a").agg(spread.alias("x")).collect()}
        else:
            w, s = F.pow("n", "a"), F.sum(F.pow("n", "a"))
            ok = {r["a"]: r["x"] <= entropy for r in points.groupBy("a").agg((F.log(s) - F.sum(w * F.log(w)) / s).alias("x")).collect()}
        good = [a for a, x in ok.items() if x]
        if not good:
            return 1.0
        hi = min(good)
        lo = max(lo, hi - step)
    return hi


def plan(docs: DataFrame, scratch: Scratch, source_col: str, id_col: str, tokens: Column, max_epochs: float | None, entropy: float | None, blocks: int, seed: int) -> DataFrame:
    """Per source: weight, budget, passes (whole), and how far the partial pass goes (block order, document order)."""
    d = docs.select(F.col(source_col).alias("__qr_s"), _block(id_col, blocks, seed).alias("__qr_b"), F.col(id_col).alias("__qr_id"), tokens.alias("__qr_n"))
    by_block = scratch.table(d.groupBy("__qr_s", "__qr_b").agg(F.sum("__qr_n").alias("__qr_n")), "blocks")
    totals = scratch.table(by_block.groupBy("__qr_s").agg(F.sum("__qr_n").alias("__qr_total")), "totals")
    a = exponent(totals, max_epochs, entropy)
    n = F.col("__qr_total").cast("double")
    sums = totals.where("__qr_total > 0").agg(F.sum(F.pow(n, F.lit(a))).alias("w"), F.max(F.pow(n, F.lit(1 - a))).alias("b")).first()
    total_w, budget = sums["w"] or 1.0, sums["b"] or 1.0
    # budget of a source = weight * total, with total such that the least repeated source gets one pass
    want = F.greatest(F.round(F.pow(n, F.lit(a)) * budget).cast("long"), F.col("__qr_total"))
    p = totals.withColumn("__qr_want", F.when(F.col("__qr_total") > 0, want).otherwise(F.lit(0).cast("long")))
    passes = F.when(F.col("__qr_total") > 0, F.floor(F.col("__qr_want") / F.col("__qr_total"))).otherwise(F.lit(1)).cast("long")
    p = p.select("__qr_s", "__qr_total", "__qr_want", (F.pow(n, F.lit(a)) / total_w).alias("__qr_weight"), passes.alias("__qr_passes"))
    p = scratch.table(p.withColumn("__qr_rest", F.col("__qr_want") - F.col("__qr_passes") * F.col("__qr_total")), "plan")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    w = Window.partitionBy("__qr_s").orderBy("__qr_o", "__qr_b").rowsBetween(Window.unboundedPreceding, 0)
    rest = p.select(F.col("__qr_s").alias("__qr_ps"), "__qr_passes", "__qr_rest")
    runs = by_block.join(rest, same("__qr_s", "__qr_ps")).withColumn("__qr_o", _order(F.col("__qr_passes"), F.col("__qr_b"), seed)).withColumn("__qr_run", F.sum("__qr_n").over(w))
    last = runs.where("__qr_run > __qr_rest").groupBy("__qr_s").agg(F.min(F.struct("__qr_o", "__qr_b", (F.col("__qr_rest") - F.col("__qr_run") + F.col("__qr_n")).alias("left"))).alias("__qr_l"))
    last = scratch.table(last.select(F.col("__qr_s").alias("__qr_ls"), F.col("__qr_l.__qr_o").alias("__qr_lo"), F.col("__qr_l.__qr_b").alias("__qr_lb"), F.col("__qr_l.left").alias("__qr_left")), "last")
    # documents of the one block that is cut: taken while their running sum fits
    cut = d.join(last, same("__qr_s", "__qr_ls") & (F.col("__qr_b") == F.col("__qr_lb"))).withColumn("__qr_h", _hash("__qr_id", F.lit(seed + 1)))
    per = cut.groupBy("__qr_s", "__qr_h").agg(F.sum("__qr_n").alias("__qr_n"), F.first("__qr_left").alias("__qr_left"))
    w = Window.partitionBy("__qr_s").orderBy("__qr_h").rowsBetween(Window.unboundedPreceding, 0)
    upto = per.withColumn("__qr_run", F.sum("__qr_n").over(w)).where("__qr_run <= __qr_left").groupBy("__qr_s").agg(F.max("__qr_h").alias("__qr_lh")).withColumnRenamed("__qr_s", "__qr_us")
    full = last.join(upto, same("__qr_ls", "__qr_us"), "left")
    return scratch.table(p.join(full, same("__qr_s", "__qr_ls"), "left").select(F.col("__qr_s").alias("__qr_ps"), "__qr_weight", "__qr_want", "__qr_passes", "__qr_lo", "__qr_lb", F.coalesce("__qr_lh", F.lit(-1)).alias("__qr_lh")), "decisions")


def _block(id_col: str, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(blocks)).cast("int")


def _order(epoch: Column, block: Column, seed: int) -> Column:
    return _hash(F.lit(seed), epoch.cast("long"), block)


def mix(docs: DataFrame, max_epochs: float | None = 1.25, entropy: float | None = None, source_col: str = "source", id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text", blocks: int = 4096, seed: int = 17) -> DataFrame:
    """docs, each row once per pass that takes it, with __qr_epoch, __qr_block, __qr_order, __qr_tokens and __qr_weight.

    Sorting a source by (__qr_epoch, __qr_order) gives its schedule of block permutations.
    """
    if (max_epochs is None) == (entropy is None):
        raise ValueError("give either a repetition limit or an entropy")
    scratch = Scratch(docs.sparkSession, "mix")
    tokens = words(F.col(text_col)) if tokens is None else tokens
    p = plan(docs, scratch, source_col, id_col, tokens, max_epochs, entropy, blocks, seed)
    j = docs.join(p, F.col(source_col).eqNullSafe(F.col("__qr_ps")), "left").withColumn("__qr_block", _block(id_col, blocks, seed))
    order = _order(F.col("__qr_passes"), F.col("__qr_block"), seed)
    before = (order < F.col("__qr_lo")) | ((order == F.col("__qr_lo")) & (F.col("__qr_block") < F.col("__qr_lb")))
    within = (F.col("__qr_block") == F.col("__qr_lb")) & (_hash(F.col(id_col), F.lit(seed + 1)) <= F.col("__qr_lh"))
    times = F.col("__qr_passes") + F.coalesce((before | within) & (tokens > 0), F.lit(False)).cast("int")
    keep = [F.col(c) for c in docs.columns]
    j = j.select(*keep, "__qr_block", F.col("__qr_weight"), tokens.alias("__qr_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("__qr_epoch"))
    return j.select(*keep, F.col("__qr_epoch").cast("int").alias("__qr_epoch"), "__qr_block", _order(F.col("__qr_epoch") - 1, F.col("__qr_block"), seed).alias("__qr_order"), "__qr_tokens", "__qr_weight")

"""Per-host politeness over a request log, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_DELAY, BUDGET, BLOCK_LIMIT = 6.0, 25, 2


def gaps(log: DataFrame) -> DataFrame:
    """log (host, seq, ts_us) -> seconds since the host's previous request and how long it should have waited."""
    w = Window.partitionBy("host").orderBy("ts_us", "seq")
    gap = (F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6
    return log.withColumn("gap", F.round(gap, 3)).withColumn("wait", F.round(F.greatest(F.coalesce(F.lit(MIN_DELAY) - F.col("gap"), F.lit(0.0)), F.lit(0.0)), 3))


def budget(log: DataFrame, most: int = BUDGET) -> DataFrame:
    """Running count per host and whether the request is within the budget."""
    w = Window.partitionBy("host").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("n") <= most)


def block_streaks(log: DataFrame) -> DataFrame:
    """log with status -> streak: refusals since the last success (2xx, 3xx) of the host."""
    w = Window.partitionBy("host").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    ok, blocked = F.col("status").between(200, 399), F.col("status").isin(403, 429, 503)
    island = log.withColumn("island", F.sum(ok.cast("long")).over(w))
    inside = Window.partitionBy("host", "island").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(blocked.cast("long")).over(inside)).drop("island").withColumn("parked", F.col("streak") >= BLOCK_LIMIT)

"""Sinks: index, records, drafts, tombstones, reports, traces. A rerun replaces only what it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors, by category: a search in one category reads that folder only."""
    chunks.write.mode("overwrite").partitionBy("category").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Replaces the categories that occur in `records`; others stay as they are."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category").parquet(path)


def drafts(found: DataFrame) -> DataFrame:
    """What an agent proposes: never verified, and refused without a filled audience_check."""
    return found.where(F.length(F.trim(F.coalesce("audience_check", F.lit("")))) > 0).withColumn("status", F.lit("unverified"))


def write_drafts(found: DataFrame, path: str) -> None:
    drafts(found).write.mode("append").parquet(path)


def write_not_found(tried: DataFrame, path: str) -> None:
    """Tombstones (category, reason, at) of searches without a source."""
    tried.select("category", "reason", "at").write.mode("append").json(path)


def write_report(findings: DataFrame, path: str, run_date: str) -> None:
    """A drift or audit report of one run; the same run date is replaced."""
    findings.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)


def write_trace(steps: DataFrame, path: str) -> None:
    """Agent steps (step, tool, args, result)."""
    steps.select("step", "tool", "args", "result").write.mode("append").json(path)


def gate(violations: DataFrame) -> bool:
    """Whether a run passes: no violation row. Reads at most one."""
    return violations.limit(1).count() == 0


def write_raw(fetched: DataFrame, path: str) -> None:
    """Bodies with what is known of them (url, final_url, status, content_type, fetched_at, body), by the day they were read."""
    fetched.withColumn("day", F.to_date("fetched_at")).write.mode("append").partitionBy("day").parquet(path)

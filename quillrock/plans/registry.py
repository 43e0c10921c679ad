"""Where queries of the plan modules and their SQL are registered, and how they read tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")

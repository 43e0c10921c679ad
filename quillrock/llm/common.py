"""Shared helpers of the corpus operators: scratch tables, joins that split hot keys, Arrow scans."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


#: While it is set, Spark deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written under spark.checkpoint.dir, so that no lineage or executor-local block is needed.

    Where the session names no folder (tests in local mode) a temporary one is used; with any other
    master that is an error, since executors would not share it.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillrock-")
        ship(spark)
        self.spark, self.root, self.names = spark, f"{base.rstrip('/')}/quillrock/{label}-{uuid.uuid4().hex[:12]}", set()
        atexit.register(self.clear)

    def table(self, df: DataFrame, name: str, partitions: list[str] | None = None, random: bool = False) -> DataFrame:
        """df, written and read again. What the write shuffled is deleted with its end: the table takes its place.

        random: of hashes only, which neither a dictionary nor a codec makes smaller.
        """
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        if random:
            writer = writer.option("compression", "none").option("parquet.enable.dictionary", "false")
        was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, was)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete every table but these."""
        self.drop(*sorted(self.names.difference(names)))

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # at exit the JVM may be gone; the shared folder is the cluster's to clean
            pass

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 2_000_000, text: str = "text"):
    """Cut Arrow batches so that a slice holds a bounded number of rows and, but for one long text, of bytes."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        start = size = 0
        lengths = pa.compute.binary_length(col).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or size + n > chars):
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield b.slice(start)


#: Rows of one key that stay together in split_join.
TOGETHER = 128


#: Keys, at most, that split_join deals out.
MOST_SPLIT = 2000


def split_join(left: DataFrame, right: DataFrame, key: str, by, how: str = "inner", counted: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Equi-join (inner or left) of rows that may pile up on a whole-number key against one row per key.

    A key with more than TOGETHER rows is dealt, by the hash of `by`, over about as many salts as it has that many rows,
    and its one row on the right is repeated for each; so the right side grows by little beside the left one. Only the
    most frequent keys count, twice the partitions or MOST_SPLIT: a further one has few rows beside a task's. They
    are collected, a bounded number, and stand in the plan as sets of literals. `counted`: a written table with the
    keys of left; `counts`: (key, __n), where they are known.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = (left if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where((F.col("__n") > TOGETHER) & F.col(key).isNotNull()).orderBy(F.desc("__n")).limit(min(2 * parts, MOST_SPLIT)).collect()
    if not hot:
        return left.join(right, key, how)
    by_salts: dict[int, list[int]] = {}
    for r in hot:
        by_salts.setdefault(min(1 << (r["__n"] // TOGETHER).bit_length(), 4 * parts), []).append(r[key])
    salts = F.lit(1)
    for n, keys in by_salts.items():
        salts = F.when(F.col(key).isin(keys), n).otherwise(salts)
    l = left.withColumn("__salt", F.pmod(F.xxhash64(by), salts).cast("int"))
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return l.join(r, [key, "__salt"], how).drop("__salt")


_state: dict[str, object] = {}


def worker_state(key: str, make):
    """What this worker keeps between tasks, such as a loaded tokenizer and its cache: of one kind only, the last asked for."""
    if key not in _state:
        _state.clear()
        trim()
        _state[key] = make()
    return _state[key]


def trim() -> None:
    """Give a worker's free memory back, so that the next stage's worker state does not add to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)

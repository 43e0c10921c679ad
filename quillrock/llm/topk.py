"""Exact inner-product top-k by norm buckets.

Vectors are range-partitioned by length, longest first; each batch of neighbours is a bucket. For a query and
a bucket, the k-th best score so far over (query length * longest length) is a local cosine threshold. Above
1 the bucket is skipped for that query. A high threshold selects coordinate pruning: a vector that reaches it
has its component along the query's largest coordinate in a computed interval. Otherwise length pruning cuts
the bucket where vectors get too short. What is left is verified by exact integer products.

Queries come in blocks of at most `block` rows, so that what is broadcast is bounded; each block takes one
pass over the vectors. A task hands on at most k rows a query.

Before the scan the SEED longest vectors go to the tasks that hold the queries: each query's k-th best score among them is
a threshold that every task starts from, so later buckets are pruned from their first row. Queries grow with the
vectors, and with them the passes: one for some block / 2 queries.

Odd cases: rows with a null or empty vector, null or non-finite components take no part; vectors of another
dimension than the query's are no candidates; each row counts, so rows that repeat an id are candidates (and
queries) each, and only a query's own row is none of its candidates; a null id is no query, and last among ties;
rows that tie in score and id come in any order, which leaves the result the same; an empty table gives an empty
result; extra columns are ignored. Products are summed in
doubles where these are exact, else in Python's integers; a score beyond 64 bits is the greatest or least of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

EXACT = 2.0**53
HIGH = 0.7
LEAST = np.iinfo(np.int64).min
#: Greatest id; stands for a null one.
NO_ID = 2**63 - 1
#: Longest vectors that are searched first.
SEED = 4096


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, v array<long>, norm) of the rows that take part; a null id stands as NO_ID."""
    raw = F.col(vec_col).cast("array<double>")
    ok = (F.size(raw) > 0) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(F.coalesce(x, F.lit(0.0))) == float("inf")))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    v = vectors.where(F.coalesce(ok, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), ident.alias("id"), F.transform(raw, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as int64."""
    if not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(v).T, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


class Best:
    """The k best of each query, score descending, then id ascending; scores below a query's floor don't count."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), NO_ID)
        self.floor = np.full(n, LEAST) if floor is None else floor

    def least(self) -> np.ndarray:
        """Scores that a vector must reach."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= max(self.score[q, -1], self.floor[q])
        if keep.any():
            s, i = np.concatenate((self.score[q], scores[keep])), np.concatenate((self.id[q], ids[keep]))
            top = np.lexsort((i, ~s))[: self.k]
            self.score[q], self.id[q] = s[top], i[top]


def search_bucket(q: np.ndarray, q_norm: np.ndarray, q_row: np.ndarray, v: np.ndarray, norm: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
    """One bucket, sorted by descending norm, against all queries of a block."""
    most = norm[0]
    at_least = best.least()
    theta = at_least.astype(float)
    theta[at_least == LEAST] = -np.inf
    theta -= np.abs(np.where(np.isfinite(theta), theta, 0)) * 1e-12
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((q_norm > 0) & (most > 0), theta / (q_norm * most), np.where(theta > 0, np.inf, -np.inf))
    wide = np.flatnonzero(local <= HIGH)
    if len(wide):  # length pruning: too short a vector can't reach the k-th score
        reach = np.where((theta[wide] > 0) & (q_norm[wide] > 0), theta[wide] / np.maximum(q_norm[wide], 1e-300) * (1 - 1e-9), 0)
        upto = len(norm) - np.searchsorted(norm[::-1], reach, side="left")
        for part in np.array_split(wide, max(1, len(wide) * len(norm) // 4_000_000 + 1)):
            scores = products(q[part], v[: int(upto[np.searchsorted(wide, part)].max())])
            for row, i in enumerate(part.tolist()):
                s = scores[row, : int(upto[np.searchsorted(wide, i)])]
                ok = np.flatnonzero((s >= at_least[i]) & (rows[: len(s)] != q_row[i]))
                if len(ok) > 4 * best.k:
                    cut = np.partition(s[ok], len(ok) - best.k)[len(ok) - best.k]
                    ok = ok[s[ok] >= cut]
                best.add(i, s[ok], ids[ok])
    narrow = np.flatnonzero((local > HIGH) & (local <= 1 + 1e-9))
    if len(narrow):
        unit = v / np.maximum(norm, 1e-300)[:, None]
        for i in narrow.tolist():
            t = min(1.0, local[i])
            f = int(np.abs(q[i]).argmax())
            x = q[i, f] / q_norm[i]
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-6
            # at cosine c >= t: |u_f - c x| <= sqrt((1 - c c)(1 - x x)); the interval over all such c
            lo = -1.0 if x <= -t else x * t - spread
            hi = 1.0 if x >= t else x * t + spread
            ok = np.flatnonzero((unit[:, f] >= lo) & (unit[:, f] <= hi) & (rows != q_row[i]))
            s = products(q[i : i + 1], v[ok])[0]
            best.add(i, s, ids[ok])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, which are the rows whose id is divisible by `every`."""
    scratch = Scratch(vectors.sparkSession, "topk")
    sc = vectors.sparkSession.sparkContext
    v = scratch.table(quantised(vectors, id_col, vec_col, scale), "vectors")
    parts = v.rdd.getNumPartitions()
    ordered = scratch.table(v.repartitionByRange(max(1, parts), F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row"), "buckets")
    queries = v.where((F.pmod("id", F.lit(every)) == 0) & (F.col("id") != NO_ID))
    # blocks by hash: sizes differ little, and a block is bounded by splitting on the count
    blocks = max(1, -(-2 * queries.count() // block))
    queries = queries.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    longest = v.orderBy(F.desc("norm"), "row").limit(SEED).select("row", "v").collect()
    first = sc.broadcast(_by_dimension(longest))
    found = None
    for i in range(blocks):
        asked: dict[int, list] = {}
        floored = queries.where(F.col("b") == i).select("row", "id", "v", "norm").mapInArrow(_floors(first, k), "row long, id long, v array<long>, norm double, floor long")
        for r in sorted(floored.collect(), key=lambda r: r["row"]):
            asked.setdefault(len(r["v"]), []).append(r)
        sent = sc.broadcast({d: _block(rows) for d, rows in asked.items()})

        def run(batches, sent=sent):
            state = {d: (q, norm, row, qid, Best(len(row), k, floor)) for d, (q, norm, row, qid, floor) in sent.value.items()}
            for b in batches:
                width = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
                for d in np.unique(width).tolist():
                    if d in state:
                        part = b.filter(pa.array(width == d))
                        for at in range(0, len(part), 4096):
                            x = part.slice(at, 4096)
                            search_bucket(*state[d][:3], _matrix(x.column(2)), x.column(3).to_numpy(), x.column(1).to_numpy(), x.column(0).to_numpy(), state[d][4])
            for _, _, row, qid, best in state.values():
                got = best.score > LEAST
                at, _ = np.nonzero(got)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(qid[at]), pa.array(best.id[got]), pa.array(best.score[got])], ["q", "query_id", "vec_id", "score"])

        one = ordered.select("row", "id", "v", "norm").mapInArrow(run, "q long, query_id long, vec_id long, score long")
        # only k rows a query and task come here
        w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        one = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
        one = scratch.table(one, f"found{i}")
        sent.unpersist()
        found = one if found is None else found.unionByName(one)
    first.unpersist()
    return found


def _by_dimension(longest: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors by dimension."""
    by: dict[int, list] = {}
    for r in longest:
        by.setdefault(len(r["v"]), []).append(r)
    return {d: (np.array([r["row"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)) for d, rows in by.items()}


def _floors(first, k: int):
    """For mapInArrow over queries (row, id, v, norm): the k-th score of each among the longest vectors, where there are so many others."""

    def run(batches):
        for b in batches:
            width = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            floor = np.full(len(b), LEAST)
            for d in np.unique(width).tolist():
                own, v = first.value.get(d, (np.empty(0, np.int64), None))
                if len(own) <= k:
                    continue
                at = np.flatnonzero(width == d)
                for part in np.array_split(at, max(1, len(at) * len(own) // 4_000_000)):
                    q = b.take(pa.array(part))
                    s = products(_matrix(q.column(2)), v)
                    s[q.column(0).to_numpy()[:, None] == own] = LEAST
                    floor[part] = np.partition(s, len(own) - k, axis=1)[:, len(own) - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor)], [*b.schema.names, "floor"])

    return run


def _block(rows: list) -> tuple:
    """Queries of one dimension as arrays: vectors, norms, rows, ids, floors."""
    q, norm = np.array([r["v"] for r in rows], np.float64), np.array([r["norm"] for r in rows])
    return q, norm, *(np.array([r[c] for r in rows], np.int64) for c in ("row", "id", "floor"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
"""

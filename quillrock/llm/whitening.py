"""Embedding whitening: one streaming pass of moments, a symmetric QR eigen-solve, projections.

Each task runs Welford's rank-one updates over its rows: count, mean and the centred second moment, besides exact
whole-number sums. The states, one row a task, are merged by the parallel update formula in a tree of Spark tasks
(FAN states each), so the driver reads one state, whose size is the square of the dimension whatever the corpus.
The driver tridiagonalises the covariance and runs implicit QR shifts on it (`symmetric_qr`). Whitened rows go through
the same moments once more: how far their covariance is from the identity is measured, not assumed.

Components become longs floor(scale * c) + OFFSET before anything else, so sums and deviations are exact; products are
of centred values only. An estimate needs no more precision than doubles: a state's error grows with the rounding of
its own updates, not with OFFSET.

Odd cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do rows of another
dimension than the most frequent one (of equally frequent ones the larger); entries whose long would leave +-2**52
are held there; deviations beyond 64 bits are the greatest long; rows that repeat an id, and null ids, count and are returned each; a
component without variance (not above LEAST of the largest) has whitened 0 and no part in identity_error; one
row or equal rows have no component with variance, so explained is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import Scratch

OFFSET = 1_000_000
HOLD = 2**52
#: Share of the largest eigenvalue up to which one counts as none.
LEAST = 1e-12
#: States that one task merges.
FAN = 32
MOST_LONG = 2**63 - 1
STATE = "part int, n long, sums binary, mean binary, m2 binary"


class Moments:
    """Count, exact sums, mean and centred second moment of vectors of one dimension."""

    def __init__(self, dim: int, exact: bool):
        self.n, self.mean, self.m2 = 0, np.zeros(dim), np.zeros((dim, dim))
        self.sums = [0] * dim if exact else None
        self._outer = np.empty((dim, dim))

    def add(self, rows: np.ndarray) -> None:
        """Welford: one rank-one update a row."""
        for x in rows.astype(np.float64):
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            np.multiply.outer(delta, delta * ((self.n - 1) / self.n), out=self._outer)
            self.m2 += self._outer
        if self.sums is not None:
            # longs of +-2**53 over a batch of up to 1,000 rows
            self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(0), strict=True)]

    def merge(self, n: int, sums: list[int] | None, mean: np.ndarray, m2: np.ndarray) -> None:
        """Chan's parallel update."""
        if n:
            total = self.n + n
            delta = mean - self.mean
            self.m2 += m2 + np.multiply.outer(delta, delta) * (self.n * (n / total))
            self.mean += delta * (n / total)
            self.n = total
            if self.sums is not None:
                self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]

    def row(self, part: int) -> pa.RecordBatch:
        """Sums as signed 16-byte words."""
        sums = b"".join(x.to_bytes(16, "little", signed=True) for x in self.sums or [])
        values = {"part": pa.array([part], pa.int32()), "n": pa.array([self.n], pa.int64())}
        return pa.RecordBatch.from_pydict(values | {k: pa.array([v], pa.binary()) for k, v in (("sums", sums), ("mean", self.mean.tobytes()), ("m2", self.m2.tobytes()))})


def _unpack(n, sums, mean, m2):
    mean = np.frombuffer(mean)
    return n, [int.from_bytes(sums[i : i + 16], "little", signed=True) for i in range(0, len(sums), 16)], mean, np.frombuffer(m2).reshape(len(mean), -1)


def _matrix(col: pa.ListArray, kind) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(col), -1)


def merged(states: DataFrame, dim: int, exact: bool, scratch: Scratch, name: str) -> Moments:
    """The tree of merges over a table of states; rounds of FAN to one, and one row for the driver."""

    states, i = scratch.table(states, f"{name}0"), 0
    left = states.agg(F.max("part")).first()[0]
    while left:  # numbers of parts fall FAN-fold a round; a task merges each group of FAN that it gets on its own
        i += 1
        dealt = states.withColumn("g", F.floor(F.col("part") / FAN).cast("int")).repartition(left // FAN + 1, "g").sortWithinPartitions("part")
        states = scratch.table(dealt.mapInArrow(_by_group(dim, exact), STATE), f"{name}{i}")
        left //= FAN
    out = Moments(dim, exact)
    for r in states.collect():
        out.merge(*_unpack(r["n"], r["sums"], r["mean"], r["m2"]))
    return out


def _by_group(dim: int, exact: bool):
    """Merges runs of rows of one group g, sorted by part, into one row each."""

    def run(batches):
        total, group = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["g"] != group:
                    if total is not None:
                        yield total.row(group)
                    total, group = Moments(dim, exact), r["g"]
                total.merge(*_unpack(r["n"], r["sums"], r["mean"], r["m2"]))
        if total is not None:
            yield total.row(group)

    return run


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, next diagonal and orthogonal q with a = q t q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        tail = np.abs(x[1:]).max()
        if tail == 0:
            continue
        v = x / np.abs(x).max()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - v * (v @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        x -= 2 * v * (v @ x)
        a[k, k + 1 :] = x
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: implicit QR steps with Wilkinson's shift.

    Each vector's entry of the greatest size (the first of equal ones) is positive.
    """
    d, e, q = tridiagonal(a)
    q = np.ascontiguousarray(q.T)  # rows are rotated
    hi, eps = len(d) - 1, np.finfo(float).eps
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        zeros = np.flatnonzero(e[:hi] == 0)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            rows = q[k].copy()
            q[k] = c * rows + s * q[k + 1]
            q[k + 1] = c * q[k + 1] - s * rows
    order = np.argsort(-d, kind="stable")
    d, v = d[order], q[order].T
    return d, v * np.where(v[np.abs(v).argmax(0), np.arange(len(d))] < 0, -1.0, 1.0)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    raw = F.col(vec_col).cast("array<double>")
    ok = (F.size(raw) > 0) & ~F.exists(raw, lambda c: c.isNull() | F.isnan(c) | (F.abs(F.coalesce(c, F.lit(0.0))) == float("inf")))
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c, F.lit(-1e17)), F.lit(1e17)) * scale), F.lit(-HOLD)), F.lit(HOLD))
    rows = vectors.where(F.coalesce(ok, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(raw, lambda c: held(c).cast("long") + OFFSET).alias("x"))


def stream(rows: DataFrame, column: str, dim: int, exact: bool) -> DataFrame:
    """A state of each task's rows."""

    def run(batches):
        part, total = TaskContext.get().partitionId(), Moments(dim, exact)
        for b in batches:
            x = _matrix(b.column(0), np.int64 if exact else np.float64)
            for i in range(0, len(x), 1000):
                total.add(x[i : i + 1000])
        if total.n:
            yield total.row(part)

    return rows.select(column).mapInArrow(run, STATE)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums in doubles, and the exact sums of its squares, up to the greatest long."""
    reach = n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) // max(n, 1) + 1)
    if reach < 2**62:
        far = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(far).max(initial=0)) ** 2 <= MOST_LONG:
            return far.astype(np.float64), (far * far).sum(1)
    far = x.astype(object) * n - np.array(sums, object)
    return far.astype(np.float64), np.array([min(int(v), MOST_LONG) for v in (far * far).sum(1)], np.int64)


def fit(rows: DataFrame, dim: int, scratch: Scratch, components: int = 32) -> tuple[Moments, np.ndarray, np.ndarray]:
    """The moments of all rows, a projection (dim, components) onto unit variance, and explained shares."""
    total = merged(stream(rows, "x", dim, True), dim, True, scratch, "moments")
    e, v = symmetric_qr(total.m2 / total.n)
    m = min(components, dim)
    live = e[:m] > LEAST * e[0]
    w = np.where(live, v[:, :m] / np.sqrt(np.where(live, e[:m], 1.0)), 0.0)
    trace = np.trace(total.m2) / total.n
    return total, w, np.where(live, e[:m] / (trace if trace > 0 else 1.0), 0.0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, components: int = 32) -> DataFrame:
    """One row per row that takes part: vec_id, n, deviation, whitened array<double>, explained array<double>, identity_error."""
    scratch = Scratch(vectors.sparkSession, "whiten")
    given = quantised(vectors, id_col, vec_col, scale)
    common = given.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    out = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>"
    if not common:
        return vectors.sparkSession.createDataFrame([], f"{out}, identity_error double")
    dim = common[0]["dim"]
    rows = given.where(F.size("x") == dim)
    total, w, explained = fit(rows, dim, scratch, components)
    n, sums = total.n, total.sums
    sent = vectors.sparkSession.sparkContext.broadcast((n, sums, w, explained))

    def run(batches):
        n, sums, w, explained = sent.value
        for b in batches:
            x = _matrix(b.column(1), np.int64)
            if not len(x):
                continue
            far, square = deviations(x, n, sums)
            white = (far / n) @ w
            ends = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(x), n)), pa.array(square), pa.ListArray.from_arrays(ends, pa.array(white.reshape(-1))), pa.ListArray.from_arrays(ends, pa.array(np.tile(explained, len(x))))],
                ["vec_id", "n", "deviation", "whitened", "explained"],
            )

    white = scratch.table(rows.mapInArrow(run, out), "white")
    check = merged(stream(white, "whitened", w.shape[1], False), w.shape[1], False, scratch, "check")
    live = explained > 0
    off = np.abs(check.m2 / n - np.eye(len(live)))[np.ix_(live, live)]
    return white.withColumn("identity_error", F.lit(float(off.max(initial=0.0))))


def digest(whitened: DataFrame) -> DataFrame:
    """One row per row and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("p", "c")
    long = whitened.select("vec_id", "n", "deviation", "identity_error", pairs)
    return long.select("vec_id", (F.col("p") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")

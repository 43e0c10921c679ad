"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics. Per language and source a minimum-covariance-
determinant estimate is fitted over all its documents: concentration steps from several starts (STARTS), of which the
one whose nearest three quarters have the least determinant is taken. A step never gathers a group: distances fall
into bins of fixed width, moments are summed per group and bin inside the tasks, and the nearest rows are the moments
of the nearest bins. So a group of any size costs the same few rows. A document whose squared Mahalanobis distance
passes `cutoff` is rejected.

Estimates are made for groups, languages and the whole table, and each group's is drawn to its language's, and that
one's to the table's, as if the larger one were `prior` further rows. So there is no size at which the rules change: a
single document has its language's estimate, a large group its own. Documents that fail the fixed limits are not fitted.

Odd cases: null text has no words; null language or source is a value of its own; rows that repeat are fitted
and judged each; extra columns are ignored; constant statistics are held by a floor on their spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import Scratch, slices

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Least standard deviation of each statistic, in its transformed unit; 0.03 is one symbol in some 1,100 characters.
FLOORS = np.array([0.4, 0.12, 0.03, 0.13, 0.15])
DIM = len(FLOORS)
#: Median of chi-square with 5 degrees of freedom: distances are scaled to it.
CHI2_MEDIAN = 4.351
#: Its 99.999 % quantile.
CUTOFF = 30.856
PER_BIN = 8.0
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_U = np.uint64


def text_statistics(texts: list[str | None]) -> np.ndarray:
    """Rows of STATS."""
    raw = [(t or "").encode() for t in texts]
    flat, n = S.word_hashes(raw)
    out = np.zeros((len(texts), 6), np.int64)
    out[:, 0] = n
    for i, (t, b) in enumerate(zip(texts, raw, strict=True)):
        if n[i]:
            out[i, 1] = len(t) - (len(b) - len(b.translate(None, SPACES)))
            out[i, 2] = len(b) - len(b.translate(None, SYMBOLS))
            lines = [line for line in b.split(b"\n") if not line.isspace() and line]
            out[i, 3] = len(lines) - len(set(lines))
            out[i, 5] = len(lines)
    total = len(flat)
    if total >= WINDOW:
        roll = np.zeros(total - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            roll = roll * _U(0xD6E8FEB86659FD93) + flat[j : total - WINDOW + 1 + j]
        doc = np.repeat(np.arange(len(raw)), n)
        at = np.flatnonzero(doc[: len(roll)] == doc[WINDOW - 1 :])
        h = S.mix(roll[at])
        order = S.ordered(doc[at], h)
        same = (h[order][1:] == h[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(total + 1, np.int64)
        start = at[order][twice]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out[:, 4] = np.bincount(doc[covered], minlength=len(raw))
    return out


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            got = text_statistics(b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(got[:, i]) for i in range(6))], ["id", "lang", "source", *(c.split()[0] for c in STATS.split(", "))])

    cols = [F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*cols).mapInArrow(run, f"id long, lang string, source string, {STATS}")


def vector() -> list:
    """The transformed statistics x0..x4."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")).alias("x0"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("x1"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x3"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x4"),
    ]


PARAMS = "fit string, start int, n double, mu array<double>, cov array<double>, w array<double>, logdet double"
#: Shares of the nearest rows, by medians and their deviations, that the starts take their first moments from.
STARTS = (0.75, 0.5, 1.0)


def _median_start(rows: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations from a histogram (fit, dim, bin, n), 50 bins a unit; the same for every start."""
    mu, sd = np.zeros(DIM), FLOORS.copy()
    for d, g in rows.groupby("dim"):
        g = g.sort_values("bin")
        x, n = g["bin"].to_numpy() / 50, g["n"].to_numpy()
        mu[d] = x[np.searchsorted(np.cumsum(n), n.sum() / 2)]
        far = np.abs(x - mu[d])
        order = np.argsort(far, kind="stable")
        sd[d] = max(1.4826 * far[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)], FLOORS[d])
    return _params([(str(rows["fit"].iloc[0]), -1, float(rows["n"].sum() / DIM), mu, np.diag(sd**2))])


def whitening(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(np.linalg.cholesky(cov + 1e-9 * np.eye(DIM)))


def _params(found: list[tuple]) -> pd.DataFrame:
    rows = [(fit, start, n, mu.tolist(), cov.reshape(-1).tolist(), whitening(cov).reshape(-1).tolist(), float(np.linalg.slogdet(cov)[1])) for fit, start, n, mu, cov in found]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARAMS.split(", ")])


def _nearest(rows: pd.DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the nearest `share`, from moments per distance bin; a dimension gets what it lacks to the floor."""
    rows = rows.sort_values("bin")
    n = rows["n"].to_numpy(float)
    upto = min(int(np.searchsorted(np.cumsum(n), share * n.sum() - 1e-9)) + 1, len(n))
    sums = rows[[f"s{i}" for i in range(DIM)]].to_numpy()[:upto].sum(0)
    cross = rows[[f"c{i}{j}" for i in range(DIM) for j in range(DIM) if i <= j]].to_numpy()[:upto].sum(0)
    m = n[:upto].sum()
    mu = sums / m
    cov = np.zeros((DIM, DIM))
    cov[np.triu_indices(DIM)] = cross / m
    cov = cov + np.triu(cov, 1).T - np.outer(mu, mu)
    return mu, cov + np.diag(np.maximum(FLOORS**2 - np.diag(cov), 0))


def _concentrate(rows: pd.DataFrame, share: float) -> pd.DataFrame:
    """One start's next estimate; from the medians, the first of every start."""
    fit, start, n = str(rows["fit"].iloc[0]), int(rows["start"].iloc[0]), float(rows["n"].sum())
    wanted = enumerate(STARTS) if start < 0 else [(start, share)]
    return _params([(fit, i, n, *_nearest(rows, x)) for i, x in wanted])


def shrunk(own: tuple, parent: tuple, prior: float) -> tuple:
    """(n, mu, cov) of a group drawn to its parent's, which counts as `prior` rows: a large group keeps its own, a small one has its parent's."""
    n, part = own[0], own[0] / (own[0] + prior)
    return n, part * own[1] + (1 - part) * parent[1], part * own[2] + (1 - part) * parent[2]


def _family(rows: Iterator[pd.DataFrame], all_rows: tuple, prior: float) -> Iterator[pd.DataFrame]:
    """Final estimates of groups from rows (own, n, mu, cov, and the same of its language)."""
    for pdf in rows:
        out = []
        for r in pdf.itertuples(index=False):
            level = lambda n, mu, cov: (n, np.array(mu), np.array(cov).reshape(DIM, DIM))
            got = shrunk(level(r.n2, r.mu2, r.cov2), level(*all_rows), prior)
            _, mu, cov = shrunk(level(r.n, r.mu, r.cov), got, prior)
            out.append((r.own, mu.tolist(), whitening(cov).reshape(-1).tolist()))
        yield pd.DataFrame(out, columns=["own", "mu", "w"])


def _rescale(rows: pd.DataFrame) -> pd.DataFrame:
    """A group's rows and the median of their distances over that of chi-square."""
    rows = rows.sort_values("bin")
    n = rows["n"].to_numpy()
    median = np.exp((rows["bin"].to_numpy()[np.searchsorted(np.cumsum(n), n.sum() / 2)] + 0.5) / PER_BIN)
    return pd.DataFrame({"fit": [rows["fit"].iloc[0]], "n": [float(n.sum())], "by": [median / CHI2_MEDIAN]})


def _distance(rows: DataFrame, params: DataFrame, key: str) -> DataFrame:
    """Adds d2. Params hold some rows a group; Spark broadcasts them if their files are small."""
    j = rows.join(params, key, "left")
    parts = []
    for i in range(DIM):
        terms = [F.col("w")[i * DIM + k] * (F.col(f"x{k}") - F.col("mu")[k]) for k in range(i + 1)]
        y = terms[0]
        for t in terms[1:]:
            y = y + t
        parts.append(y * y)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return j.withColumn("d2", total).drop("mu", "w")


def _bin():
    return F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-3))) * PER_BIN).cast("int").alias("bin")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, steps: int = 3, cutoff: float = CUTOFF, prior: float = 100.0) -> DataFrame:
    """One row per input row: id, STATS, base_failed, d2 (null: not judged), kept.

    prior: rows that a group's language, and a language's whole table, count for in its estimate.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.table(statistics(docs, id_col, text_col, lang_col, source_col), "stats")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    named = F.coalesce("lang", F.lit("\u0002"))
    rows = stats.withColumns({"base_failed": failed, "by_lang": F.concat(F.lit("l"), named), "own": F.concat(F.lit("g"), named, F.lit("\u0001"), F.coalesce("source", F.lit("\u0002")))}).select("*", *vector())
    xs = [f"x{i}" for i in range(DIM)]
    # each row counts in its group, in its language and in all
    used = rows.where("not base_failed").select(F.explode(F.array("own", "by_lang", F.lit("a"))).alias("fit"), *xs)
    hist = used.select("fit", F.posexplode(F.array(*(F.round(F.col(x) * 50).cast("int") for x in xs))).alias("dim", "bin")).groupBy("fit", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    params = scratch.table(hist.groupBy("fit").applyInPandas(_median_start, PARAMS), "params0")
    moments = [F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i in range(DIM) for j in range(DIM) if i <= j)]
    for step in range(1, steps + 2):
        binned = _distance(used, params.select("fit", "start", "mu", "w"), "fit").groupBy("fit", "start", _bin()).agg(*moments)
        params = scratch.table(binned.groupBy("fit", "start").applyInPandas(lambda r: _concentrate(r, share), PARAMS), f"params{step}")
    # of a group's starts the one whose nearest rows have the least determinant
    best = scratch.table(params.groupBy("fit").agg(F.min_by(F.struct("n", "mu", "cov"), F.struct("logdet", "start")).alias("b")).select("fit", "b.*"), "best")
    level = lambda i, key: best.select(F.col("fit").alias(key), *(F.col(c).alias(f"{c}{i}") for c in ("n", "mu", "cov")))
    groups = rows.where("not base_failed").select("own", "by_lang").distinct()
    lined = groups.join(best.withColumnRenamed("fit", "own"), "own").join(level(2, "by_lang"), "by_lang").drop("by_lang")
    # the whole table's estimate is one row; an empty table has no groups that would use it
    top = best.where("fit = 'a'").select("n", "mu", "cov").first()
    all_rows = (0.0, [0.0] * DIM, [0.0] * DIM**2) if top is None else (top["n"], list(top["mu"]), list(top["cov"]))
    final = scratch.table(lined.mapInPandas(lambda it: _family(it, all_rows, prior), "own string, mu array<double>, w array<double>"), "final")
    near = _distance(rows.where("not base_failed").select("own", "by_lang", *xs), final, "own")
    spread = near.select(F.explode(F.array("own", "by_lang", F.lit("a"))).alias("fit"), "d2").groupBy("fit", _bin()).agg(F.count(F.lit(1)).alias("n"))
    by = scratch.table(spread.groupBy("fit").applyInPandas(_rescale, "fit string, n double, by double"), "by")
    # medians of small groups are drawn to their language's as the estimates are
    scale = lambda i, key: by.select(F.col("fit").alias(key), F.col("n").alias(f"n{i}"), F.log("by").alias(f"by{i}"))
    b = groups.join(scale(1, "own"), "own").join(scale(2, "by_lang"), "by_lang")
    of_all = by.where("fit = 'a'").select(F.log("by")).first()
    mid = (F.col("n2") * F.col("by2") + prior * F.lit(0.0 if of_all is None else of_all[0])) / (F.col("n2") + prior)
    b = scratch.table(b.select("own", F.greatest(F.lit(1.0), F.exp((F.col("n1") * F.col("by1") + prior * mid) / (F.col("n1") + prior))).alias("by")), "scale")
    out = _distance(rows, final.join(b, "own"), "own")
    d2 = F.when(~F.col("base_failed"), F.col("d2") / F.col("by"))
    names = [c.split()[0] for c in STATS.split(", ")]
    return out.select("id", *names, "base_failed", d2.alias("d2"), (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cutoff)).alias("kept"))

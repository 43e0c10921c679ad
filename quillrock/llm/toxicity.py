"""Toxicity: a convolutional text classifier, trained in tasks, in numpy.

A word's embedding is the sum of two hashed ones, its own and that of its first STEM characters (endings
vary); filters of several widths run over them, and the greatest response of each filter in the whole text
feeds a logistic layer. Buckets that fewer than `least_docs` training texts hold stay zero, and so do, after
half of the training, those that it has hardly moved: such words answer like no word. Scoring takes every text as a whole.

The fit takes every labelled row, in rounds: each task goes once over its rows, text by text, from the same model, and the steps of
all tasks are put together, each coordinate's weighed by the squared gradients that the task saw there, so that a word few tasks
have met is not thinned out. One row in CALIBRATE is kept from the training: on these rows, counted in bins of logits, the output
bias is calibrated, so that 0.5 splits the classes best, and thresholds per language for `rejected`, by as much as their
number outweighs PRIOR rows that say nothing new, so that few rows of a language move its threshold little. The driver holds the model,
whose size is bounded, and never rows.

Language, source, id and labels are never part of a score.

Odd cases: null text scores as empty; labels that are null or without a document are ignored; with no label
of one class every score is that of the other; ids may be null or repeat, a row each; extra columns are ignored; an empty
table has no scores. Texts of any length are scored whole; of windows that tie the first one counts.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, slices, worker_state

BITS = 18
MASK = (1 << BITS) - 1
STEM = 4
DIM = 8
WIDTHS = (1, 2, 3)
CALIBRATE = 4
PRIOR = 30
#: Texts that the training goes over at least, in ROUNDS rounds; rows of a task, and tasks at most; coordinates that are put together at a time; bins of a logit's unit.
STEPS = 14_000
ROUNDS = (2, 6)
TOGETHER = 2000
TASKS = 256
BLOCK = 1 << 14
#: Error below which a text moves nothing: its gradient would be lost beside the others'.
SURE = 0.004
BINS = 64
FILTERS = 8
_TRIM = b".,;:!?\"'()[]{}|*#$%&<>"
#: Words, and stems, that a worker remembers, and the longest of the words in bytes.
_CACHE = 300_000
_LONGEST = 48


class Stems(dict):
    """Buckets of stems, already BITS higher."""

    def __missing__(self, stem: bytes) -> int:
        b = _bucket(stem, 1) << BITS
        if len(self) < _CACHE:
            self[stem] = b
        return b


class Buckets(dict):
    """Buckets of a word and, BITS higher, of its stem; lower case, without punctuation at its ends; 0 is for none."""

    def __init__(self):
        self.stems = Stems()

    def __missing__(self, word: bytes) -> int:
        w = word.strip(_TRIM)
        if w.isascii():
            w = w.lower()
            stem = w[:STEM]
        else:
            lower = w.decode().lower()
            w, stem = lower.encode(), lower[:STEM].encode()
        b = _bucket(w, 0) | self.stems[stem] if w else 0
        if len(word) <= _LONGEST and len(self) < _CACHE:
            self[word] = b
        return b


def _bucket(part: bytes, kind: int) -> int:
    return 1 + xxhash.xxh3_64_intdigest(part, kind) % MASK


def buckets(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(worker_state("buckets", Buckets).__getitem__, words), np.int64, len(words))


class Cnn:
    """Embedding, convolutions of WIDTHS, max over time, logistic output."""

    def __init__(self, known: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.slot = np.zeros(1 << BITS, np.int32)  # bucket -> row of the embedding; row 0 stays zero
        self.slot[known] = np.arange(1, len(known) + 1)
        self.emb = np.zeros((len(known) + 1, DIM), np.float32)
        self.emb[1:] = rng.normal(0, 0.05, (len(known), DIM))
        self.w = [rng.normal(0, 1 / np.sqrt(DIM * k), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = 0.0

    def joint(self) -> np.ndarray:
        """The filters side by side, (DIM, places of all widths, FILTERS); from here on self.w are views of it."""
        out = np.concatenate([w.transpose(1, 0, 2) for w in self.w], axis=1)
        self.w = [out[:, k * (k - 1) // 2 : k * (k + 1) // 2].transpose(1, 0, 2) for k in WIDTHS]
        return out

    def responses(self, words: np.ndarray, joint: np.ndarray | None = None):
        """Greatest response of each filter, its place (-1: windows of no known word), and the slots of both kinds.

        A text is padded with no-words on both sides.
        """
        joint = self.joint() if joint is None else joint
        pad = max(WIDTHS) - 1
        slots = np.zeros((2, len(words) + 2 * pad), np.int64)
        slots[0, pad : pad + len(words)] = self.slot[words & MASK]
        slots[1, pad : pad + len(words)] = self.slot[words >> BITS]
        top, where = [], []
        hot = np.flatnonzero(slots[0] | slots[1])
        dense = 2 * len(hot) > slots.shape[1]
        at = slots if dense else slots[:, hot]
        # what each place of each filter answers to a word: one product for all
        own = ((self.emb[at[0]] + self.emb[at[1]]) @ joint.reshape(DIM, -1)).reshape(at.shape[1], joint.shape[1], FILTERS)
        for k, b in zip(WIDTHS, self.b, strict=True):
            # windows without a known word all answer with the bias: one of them stands for all
            last, first = slots.shape[1] - k, k * (k - 1) // 2
            if dense:
                starts = None
                r = own[: last + 1, first].copy()
                for j in range(1, k):
                    r += own[j : last + 1 + j, first + j]
            else:
                starts, r = _windows(hot, own[:, first : first + k], slots.shape[1])
            r = np.maximum(r + b, 0)
            if starts is not None and len(starts) <= last:
                r = np.concatenate((r, np.maximum(b, 0)[None]))
                starts = np.concatenate((starts, [-1]))
            at_most = r.argmax(0)
            top.append(r[at_most, np.arange(FILTERS)])
            where.append(at_most if starts is None else starts[at_most])
        return np.concatenate(top), where, slots

    def prune(self, least: float) -> None:
        """Empty the embeddings that training has left near where they began."""
        keep = np.flatnonzero(np.linalg.norm(self.emb, axis=1) >= least)
        new = np.zeros(len(self.emb), np.int32)
        new[keep] = np.arange(1, len(keep) + 1)
        self.slot = new[self.slot]
        self.emb = np.concatenate((np.zeros((1, DIM), np.float32), self.emb[keep]))

    def logit(self, words: np.ndarray) -> float:
        return float(self.responses(words)[0] @ self.out + self.bias)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.emb.reshape(-1), *(w.reshape(-1) for w in self.w), *self.b, self.out, np.array([self.bias], np.float32)])

    def take(self, flat: np.ndarray) -> None:
        """The parameters of flat()."""
        at = 0

        def part(shape):
            nonlocal at
            n = int(np.prod(shape))
            at += n
            return flat[at - n : at].reshape(shape).astype(np.float32)

        self.emb = part(self.emb.shape)
        self.w = [part(w.shape) for w in self.w]
        self.b = [part(b.shape) for b in self.b]
        self.out, self.bias = part(self.out.shape), float(flat[at])

    def fit(self, rows, squares: np.ndarray, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
        """One pass of Adagrad over (words, label, weight), one text a step, unless its answer is SURE; squares: of the gradients so far, as flat() has them. The new ones."""
        seen = Cnn.__new__(Cnn)
        seen.emb, seen.w, seen.b, seen.out = self.emb, self.w, self.b, self.out
        seen.take(squares)
        g_emb, g_w, g_b, g_out = seen.emb, seen.w, seen.b, seen.out
        joint = self.joint()
        for words, y, weight in rows:
            top, where, slots = self.responses(words, joint)
            p = 1 / (1 + np.exp(-np.clip(top @ self.out + self.bias, -30, 30)))
            if abs(p - y) < SURE:
                continue
            err = np.float32((p - y) * weight)
            back = err * self.out * (top > 0)
            grad = err * top + decay * self.out
            g_out += grad**2
            self.out -= rate * grad / np.sqrt(g_out)
            seen.bias += float(err) ** 2
            self.bias -= rate * float(err) / np.sqrt(seen.bias)
            for n, k in enumerate(WIDTHS):
                d = back[n * FILTERS : (n + 1) * FILTERS]
                on = np.flatnonzero(d)
                if not len(on):
                    continue
                g_b[n][on] += d[on] ** 2
                self.b[n][on] -= rate * d[on] / np.sqrt(g_b[n][on])
                real = on[where[n][on] >= 0]
                for j in range(k):
                    at = where[n][real] + j
                    de = d[real, None] * self.w[n][j][:, real].T
                    dw = d[real] * (self.emb[slots[0, at]] + self.emb[slots[1, at]]).T
                    g_w[n][j][:, real] += dw**2
                    self.w[n][j][:, real] -= rate * dw / np.sqrt(g_w[n][j][:, real])
                    for held in (slots[0, at], slots[1, at]):
                        live = held > 0
                        if live.any():  # a word that several filters chose gets their summed gradient
                            r, full = held[live], de[live]
                            if len(set(r.tolist())) < len(r):
                                r, to = np.unique(r, return_inverse=True)
                                full = np.zeros((len(r), DIM), np.float32)
                                np.add.at(full, to, de[live])
                            g_emb[r] += full**2
                            self.emb[r] -= rate * full / np.sqrt(g_emb[r])
        return seen.flat()


def _windows(hot: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, ascending, of the windows that hold one of the places `hot`, and their sums; own: what the k places of a window answer to each of them."""
    k = own.shape[1]
    touched = np.zeros(n, bool)
    for j in range(k):
        touched[hot[hot >= j] - j] = True
    touched[n - k + 1 :] = False
    starts = np.flatnonzero(touched)
    at = np.zeros(n, np.int32)
    at[starts] = np.arange(len(starts))
    r = np.zeros((len(starts), FILTERS), np.float32)
    for j in range(k):
        fits = (hot >= j) & (hot - j <= n - k)
        r[at[hot[fits] - j]] += own[fits, j]
    return starts, r


class Scorer:
    """Logits of many texts at a time. What the filters answer to a word is looked up, so a text's logit is the same in any company."""

    def __init__(self, model: Cnn):
        self.model = model
        self.table = (model.emb @ model.joint().reshape(DIM, -1)).reshape(len(model.emb), -1, FILTERS)

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        m, pad = self.model, max(WIDTHS) - 1
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        words = np.concatenate(texts)
        base = np.cumsum(lens + pad) - lens - pad  # a text begins with no-words and ends with those of the next
        own, stem = m.slot[words & MASK], m.slot[words >> BITS]
        known = np.flatnonzero(own | stem)
        hot = known + (np.repeat(np.arange(len(texts)), lens)[known] + 1) * pad
        answers = self.table[own[known]] + self.table[stem[known]]
        top = np.empty((len(texts), len(WIDTHS) * FILTERS), np.float32)
        for i, (k, b) in enumerate(zip(WIDTHS, m.b, strict=True)):
            first = k * (k - 1) // 2
            starts, r = _windows(hot, answers[:, first : first + k], len(words) + (len(texts) + 1) * pad)
            edges = np.searchsorted(starts, np.append(base, len(words) + len(texts) * pad))
            count = np.diff(edges)
            best = np.zeros((len(texts), FILTERS), np.float32)
            some = np.flatnonzero(count)
            if len(some):
                best[some] = np.maximum(np.maximum.reduceat(r, edges[some]) + b, 0)
            bare = count < lens + 2 * pad - k + 1
            best[bare] = np.maximum(best[bare], b)
            top[:, i * FILTERS : (i + 1) * FILTERS] = best
        return (top * m.out).sum(1).astype(np.float64) + m.bias


def split_point(logits: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The middle of the gap between two neighbouring logits with the best balanced accuracy; rows of both classes by logit."""
    z, at = np.unique(logits, return_inverse=True)
    pos, neg = np.bincount(at, positive, len(z)), np.bincount(at, negative, len(z))
    below_pos, below_neg = np.concatenate(([0], np.cumsum(pos))), np.concatenate(([0], np.cumsum(neg)))
    score = (pos.sum() - below_pos) / max(pos.sum(), 1) + below_neg / max(neg.sum(), 1)
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    best = np.flatnonzero(score >= score.max() - 1e-12)
    return float(edges[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", least_docs: int = 3, folds: int = 5):
    """(model, thresholds by language) from every labelled document, fold 0 left out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    outside = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)) != 0
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & outside(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    rows = docs.where(outside(F.col(id_col))).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t"), F.col(lang_col).cast("string").alias("__l")).join(named, "__id")
    # of rows that share an id the one of the least text hash, so that the fit is the same every time
    rows = rows.groupBy("__id").agg(F.min_by(F.struct("__t", "__l", "__y"), F.struct(F.xxhash64("__t"), "__l")).alias("r")).select("__id", "r.*")

    def coded(batches):
        for b in slices(batches, text="__t"):
            codes = [buckets(x).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), b.column(2), b.column(3)], ["id", "w", "l", "y"])

    spare = F.pmod(F.crc32(F.concat(F.lit("s"), F.col("id").cast("string")).cast("binary")), F.lit(CALIBRATE)) == 0
    rows = scratch.table(rows.select("__id", "__t", "__l", "__y").mapInArrow(coded, "id long, w binary, l string, y int").withColumn("spare", spare), "rows")
    count = {(r["spare"], r["y"]): r["n"] for r in rows.groupBy("spare", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = all(count.get((s, c)) for s in (False, True) for c in (0, 1))
    sizes = [sum(count.get((s, c), 0) for s in (False, True)) for c in (0, 1)]
    if not all(sizes):
        model = Cnn(np.zeros(0, np.int64))
        model.out[:] = 0
        model.bias = 4.0 if sizes[1] else -4.0
        scratch.clear()
        return model, {}
    known = _known(rows, least_docs)
    model = _trained(spark, scratch, rows, sizes, known)
    if not apart:
        scratch.clear()
        return model, {}
    # a second model that has not seen the spare rows tells where the classes of others part
    other = _trained(spark, scratch, rows.where("not spare"), [count[False, c] for c in (0, 1)], known)
    z, t, n, langs = _logits(spark, rows.where("spare"), other)
    at = split_point(z, n * t, n * (1 - t)) * _trust(n, t)
    thresholds = {}
    for lang in set(langs) - {None}:
        of = np.array([x == lang for x in langs])
        if _trust(n[of], t[of]):
            thresholds[lang] = float(np.clip(split_point(z[of], n[of] * t[of], n[of] * (1 - t[of])) - at, -1, 1) * _trust(n[of], t[of]))
    model.bias -= at
    scratch.clear()
    return model, thresholds


def _known(rows: DataFrame, least: int) -> np.ndarray:
    """Buckets that at least so many texts hold, of 2^BITS at most."""

    def count(batches):
        held = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for w in b.column(0).to_pylist():
                t = np.frombuffer(w, np.int64)
                held[np.unique(np.concatenate((t & MASK, t >> BITS)))] += 1
        held[0] = 0
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["at", "n"])

    found = rows.select("w").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("at").toArrow().column(0).to_numpy())


def _trained(spark, scratch: Scratch, rows: DataFrame, sizes: list[int], known: np.ndarray) -> Cnn:
    """A model of these rows, `sizes` of each class, which count alike. The driver puts whole rounds together, at most 2^BITS embeddings."""
    model, n = Cnn(known), sum(sizes)
    squares = np.full(len(model.flat()), 1e-3, np.float32)
    weight = [0.5 * n / s for s in sizes]
    tasks, rounds = min(max(1, n // TOGETHER), TASKS), min(max(-(-STEPS // n), ROUNDS[0]), ROUNDS[1])
    dealt = rows.select("id", "w", "y").repartition(tasks, "id")

    def steps(sent):
        def run(batches):
            import copy

            given, squares = sent.value
            cnn = copy.copy(given)
            cnn.take(given.flat())
            texts = ((np.frombuffer(w, np.int64), y, weight[y]) for b in batches for w, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            more = cnn.fit(texts, squares) - squares
            step = (cnn.flat() - given.flat()) * more
            for i in range(0, len(more), BLOCK):
                g = more[i : i + BLOCK]
                if g.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([step[i : i + BLOCK].tobytes()]), pa.array([g.tobytes()]), pa.array([(g * g).tobytes()])], ["at", "step", "g", "gg"])

        return run

    def merge(table: pa.Table) -> pa.Table:
        step, g, gg = (sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column(c).to_pylist()) for c in ("step", "g", "gg"))
        total = np.maximum(g, 1e-30)
        return pa.table({"at": table.column("at")[:1], "step": [(step / total).astype(np.float32).tobytes()], "g": [(gg / total).astype(np.float32).tobytes()]})

    for i in range(rounds):
        if i == rounds // 2:
            model.prune(0.3)
            squares = np.full(len(model.flat()), 1e-3, np.float32)  # the second half begins with long steps again
        sent = spark.sparkContext.broadcast((model, squares))
        done = dealt.sortWithinPartitions(F.xxhash64("id", F.lit(i)), "id").mapInArrow(steps(sent), "at long, step binary, g binary, gg binary").groupBy("at").applyInArrow(merge, "at long, step binary, g binary")
        flat, squares = model.flat(), squares.copy()
        for r in scratch.table(done, f"round{i}").collect():
            step, g = np.frombuffer(r["step"], np.float32), np.frombuffer(r["g"], np.float32)
            flat[r["at"] : r["at"] + len(step)] += step
            squares[r["at"] : r["at"] + len(g)] += g
        scratch.drop(f"round{i}")
        sent.unpersist()
        model.take(flat)
    return model


def _logits(spark, rows: DataFrame, model: Cnn):
    """(logit, label, number, language) of rows by bins of logits, BINS a unit; those beyond 32 are held there."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        logits = Scorer(sent.value)
        for b in slices(batches, text="w", chars=8_000_000):
            z = logits([np.frombuffer(w, np.int64) for w in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(z, -32, 32) * BINS).astype(np.int64)), b.column(1), b.column(2)], ["z", "y", "l"])

    got = rows.select("w", "y", "l").mapInArrow(run, "z long, y int, l string").groupBy("z", "y", "l").agg(F.count(F.lit(1)).alias("n")).orderBy("z", "y", "l").collect()
    return (np.array([r["z"] for r in got]) + 0.5) / BINS, np.array([r["y"] for r in got]), np.array([r["n"] for r in got], float), [r["l"] for r in got]


def _trust(n: np.ndarray, y: np.ndarray) -> float:
    """Weight of what so many rows say against PRIOR rows that say nothing new; 0 without rows of both classes."""
    least = min(n[y == 1].sum(), n[y == 0].sum())
    return float(least / (least + PRIOR))


def score(docs: DataFrame, model: Cnn, thresholds: dict[str, float], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, score, rejected (by the threshold of the language, else at 0.5)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        logits = Scorer(sent.value)
        for b in slices(batches):
            z = logits([buckets(t) for t in b.column(2).to_pylist()])
            cut = np.array([thresholds.get(x, 0.0) for x in b.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(z >= cut)], ["id", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double, rejected boolean")


def clean(docs: DataFrame, model: Cnn, thresholds: dict[str, float], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; no shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    t, l = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        logits = Scorer(sent.value)
        for b in slices(batches, text=text_col):
            z = logits([buckets(x) for x in b.column(t).to_pylist()])
            yield b.filter(pa.array(z < np.array([thresholds.get(x, 0.0) for x in b.column(l).to_pylist()])))

    return docs.mapInArrow(run, docs.schema)

"""The place where a text model is plugged in: anything that turns a batch of texts into unit vectors.

HashedGrams stands in where no model can be had: counts of character n-grams in hashed places, of unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What models of this family expect before a question and before a passage (fixed values).
PREFIX = {"query": "query: ", "passage": "passage: "}


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray:
        """len(texts) rows of dim floats; any length."""


class HashedGrams:
    """Deterministic: the same text has the same vector in every process."""

    #: Hashes of grams that a model remembers.
    MOST = 500_000

    def __init__(self, dim: int = 64, grams: tuple[int, ...] = (2, 3)):
        self.dim, self.grams, self.known = dim, grams, {}

    def _hashes(self, grams: list[bytes]) -> list[int]:
        out = []
        for g in grams:
            h = self.known.get(g)
            if h is None:
                h = xxhash.xxh3_64_intdigest(g.decode("utf-32-le"))
                if len(self.known) < self.MOST:
                    self.known[g] = h
            out.append(h)
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A text's distinct grams are hashed, each once, and count as often as they stand in it."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            points = np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), "<u4")
            for n in self.grams:
                if len(points) < n:
                    continue
                grams, times = np.unique(_windows(points, n), return_counts=True)
                raw = np.stack([(grams >> (BITS * (n - 1 - j))) & ((1 << BITS) - 1) for j in range(n)], 1).astype("<u4") if n <= WIDE else grams
                whole = raw.tobytes()
                h = np.array(self._hashes([whole[j : j + 4 * n] for j in range(0, len(whole), 4 * n)]), np.uint64)
                signed = np.where(h >> np.uint64(63), times, -times)
                out[i] += np.bincount((h % np.uint64(self.dim)).astype(np.int64), signed, self.dim).astype(np.float32)
        return out


#: Bits of a code point, and points that fit one number.
BITS, WIDE = 21, 3


def _windows(points: np.ndarray, n: int) -> np.ndarray:
    """All runs of n code points: numbers, or bytes where they are too long for one."""
    if n > WIDE:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points, n)).view(np.dtype((np.void, 4 * n))).reshape(-1)
    key = np.zeros(len(points) - n + 1, np.int64)
    for j in range(n):
        key = key << BITS | points[j : len(points) - n + 1 + j]
    return key


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def prefixed(text: Column, kind: str) -> Column:
    return F.concat(F.lit(PREFIX[kind]), text)


def embed(text: Column, kind: str, model: Embedder) -> Column:
    """array<float> of unit length; null for a null text. kind: 'query' or 'passage'. The model is built once a task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            found = s.notna().to_numpy()
            v = iter(unit(model(s[found].tolist())) if found.any() else ())
            yield pd.Series([next(v) if f else None for f in found])

    return run(prefixed(text, kind))

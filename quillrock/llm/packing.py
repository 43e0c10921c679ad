"""Best-fit packing with certified bin counts.

Documents are tokenised and cut into pieces of at most `capacity` tokens; only documents longer than that are
cut. Full pieces are sequences of their own. The rest is dealt over partitions of a bounded number of pieces,
each packed by best-fit decreasing. Dual feasible functions bound from below the bins that a partition needs:
one that meets its bound is certified and closed. Partitions with a gap keep their full bins, exchange the
documents of their other bins - these are dealt anew, over fewer partitions - and are packed again, as long
as that saves bins. Only lengths are shuffled, never texts or tokens.

Odd cases: a null text counts as empty and gives one piece, the end token; an id may be null or repeat - each
row is packed on its own, so rows that repeat or tie are packed each; extra columns are ignored; an empty table
gives an empty result. A text of any length is tokenised whole; words over _LONGEST bytes are not remembered.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, worker_state

#: Words that a worker remembers, and the longest of them in bytes.
_CACHE = 800_000
_LONGEST = 64
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
DEAL_BITS = 40


class Words(dict):
    """Token ids, as bytes, of what stands between ASCII white space.

    The tokenizer drops white space and splits at it, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encode = Tokenizer.from_file(path).encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self._parts(word)
        if ids is None:
            ids = np.array(self.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= _LONGEST and len(self) < _CACHE:
            self[word] = ids
        return ids

    def _parts(self, word: bytes) -> bytes | None:
        """Ids by way of a likelier word: its lower case, or what stands before one last mark after a letter.

        The tokenizer normalises and lowers case, and then a mark after a letter begins a pre-token of its own.
        """
        if word.isalpha():
            low = word.lower()
            return self[low] if low != word else None
        if len(word) > 1 and word[-1:] in b".,;:!?" and _ends_in_letter(word[:-1]):
            return self[word[:-1]] + self[word[-1:]]
        return None


def _ends_in_letter(head: bytes) -> bool:
    """Whether the last character is an ASCII letter, or a Latin one that is still a letter when normalised in lower case."""
    if head[-1] < 128:
        return head[-1:].isalpha()
    last = head.decode()[-1]
    return last < "\u0250" and unicodedata.category(unicodedata.normalize("NFC", last).lower()[-1])[0] == "L"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        get = worker_state(tokenizer, lambda: Words(tokenizer)).__getitem__
        for b in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = b"".join(map(get, t.encode().split())) + end if t else end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            doc = b.column(0).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions on the histogram of sizes.

    f_l keeps sizes between l and capacity - l, rounds larger ones up to the capacity and drops smaller
    ones; u_k counts a size x as floor((k + 1) x / capacity) / k unless (k + 1) x is a multiple.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = int(-(-(count * x).sum() // capacity))
    from_top = np.cumsum(count[::-1])[::-1]  # pieces of size x or more
    weight = np.cumsum(count * x)
    l = np.arange(1, capacity // 2 + 1)
    large = np.where(capacity - l + 1 <= capacity, from_top[np.minimum(capacity - l + 1, capacity)], 0)
    middle = weight[capacity - l] - weight[l - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 21):
        y = (k + 1) * x
        u = np.where(y % capacity == 0, x * k, y // capacity * capacity)  # times k * capacity
        best = max(best, int(-(-(count * u).sum() // (k * capacity))))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin; best-fit decreasing.

    Open bins hang in lists by free space; an int's bits say which lists have any.
    """
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = mask >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := space - size:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = rows["length"].to_numpy()
    bins, offsets, fills = best_fit(sizes, capacity)
    certified = len(fills) == lower_bound(sizes, capacity)
    fill = fills[bins]
    return rows.assign(bin=bins, offset=offsets, closed=certified | (fill == capacity), fill=fill)[["part", "row", "doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "closed", "fill"]]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", per_part: int = 60_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rounds end where a partition is left alone, all bounds are met, or a round saves no bin.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    cut = scratch.table(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == capacity).select(*cut.columns, F.lit(-1).alias("round"), F.lit(0).cast("long").alias("part"), F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest, done = cut.where(F.col("length") < capacity), [whole]
    was, turn = -1, 0
    while True:
        n = rest.count()
        parts = max(1, -(-n // per_part))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        packed = scratch.table(
            dealt.groupBy("part").applyInPandas(lambda rows: _pack(rows, capacity), f"part long, row long, {PIECE}, bin long, offset long, closed boolean, fill long"), f"round{turn}"
        )
        columns = [*cut.columns, F.lit(turn).alias("round"), "part", "bin", "offset"]
        bins = packed.where("offset = 0 and not closed").count()
        if parts == 1 or not bins or 0 <= was <= bins:
            done.append(packed.select(*columns))
            break
        done.append(packed.where("closed").select(*columns))
        rest, was, turn = packed.where("not closed").select(*cut.columns), bins, turn + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.xxhash64("round", "part", "bin").alias("sequence_id"), "offset")

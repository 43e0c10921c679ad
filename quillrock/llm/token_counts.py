"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens.

The most frequent pre-tokens of a bounded sample of texts, `table_size` at most, become a broadcast table of
lengths. One pass splits every text, looks pre-tokens up in that table, and encodes misses, which a bounded worker
cache remembers; nothing is shuffled. Which pre-tokens are in the table changes the speed, never a count.

A pre-token is what stands between two spaces, with the space before it: the vocabulary has no piece in which
a space follows another character (checked at load), so merges never cross that border. Runs of several
spaces are split with their following word.

Odd cases: null and empty texts have 0 bytes and 0 tokens; ids may be null or repeat, a row each;
other columns are ignored; a text of any length is split whole, and pre-tokens over LONGEST_KEPT characters are not kept.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import slices, worker_state

TABLE_SIZE = 65_536
#: Texts that the table is made from, and the longest of them; they bound what the driver reads.
SAMPLE = 2_048
LONGEST_SAMPLED = 50_000
_CACHE = 300_000
#: Longest pre-token, in characters, that a table or cache keeps.
LONGEST_KEPT = 48
SPACE = "▁"
_RUNS = re.compile(" *[^ ]+| +$")


def load(path: str):
    """The sentencepiece processor of a file; raises if its pieces span words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in range(sp.get_piece_size())):
        raise ValueError(f"{path}: pieces that reach over a space cannot be counted word by word")
    return sp


def pretokens(text: str) -> list[str]:
    """Pre-tokens without their leading space where it is single; a run of more spaces stays in front."""
    text = text.replace(SPACE, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    # a space goes in front of the text; each unit then starts with one space or more
    return [u[1:] for u in _RUNS.findall(" " + text)]


class Lengths(dict):
    """Lengths of pre-tokens: starts from the broadcast table, remembers a bounded number of misses."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.sp, self.most = load(path), len(table) + _CACHE

    def __missing__(self, unit: str) -> int:
        n = len(self.sp.encode(unit)) if unit else 1  # "" stands for a lone space at the end
        if len(unit) <= LONGEST_KEPT and len(self) < self.most:
            self[unit] = n
        return n


def frequent(docs: DataFrame, text_col: str, sample: int = SAMPLE, table_size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pre-tokens of at most `sample` whole texts of up to LONGEST_SAMPLED characters. No shuffle."""
    text = F.col(text_col).cast("string")
    counts: Counter = Counter()
    for r in docs.select(text.alias("text")).where(F.length("text").between(1, LONGEST_SAMPLED)).limit(sample).collect():
        counts.update(pretokens(r["text"]))
    return [u for u, _ in counts.most_common(table_size) if u and len(u) <= LONGEST_KEPT]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    ship(spark)
    units = frequent(docs, text_col, sample, table_size)
    sp = load(model)
    table = spark.sparkContext.broadcast({u: len(sp.encode(u)) for u in units})
    key = uuid.uuid4().hex  # workers keep one call's table and cache

    def run(batches):
        get = worker_state(f"{model} {key}", lambda: Lengths(model, table.value)).__getitem__
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = [sum(map(get, pretokens(t))) if t else 0 for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long")

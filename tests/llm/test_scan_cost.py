"""What the scans of the set joins hash and sort: a word once, and members at the places asked for only."""

import random

import numpy as np
import pyarrow as pa

from quillrock.llm import shingles as S
from quillrock.llm import simjoin


class Taken:
    """Stands for a DataFrame and keeps the function of its first mapInArrow."""

    def __init__(self):
        self.runs = []

    def select(self, *names):
        return self

    def repartition(self, *names):
        return self

    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self


def test_words_have_one_hash_wherever_they_stand():
    rng = random.Random(5)
    words = {bytes(rng.choice(b"ab\x00\xc3xyz.") for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 40)))) for _ in range(4000)}
    words |= {b"a" * n for n in range(1, 60)} | {b"a" + b"\0" * n for n in range(1, 60)} | {b"12345678abcdefgh", b"abcdefgh12345678", b"x" * 8 + b"1" * 8 + b"2" * 8, b"x" * 8 + b"2" * 8 + b"1" * 8}
    words = sorted(words)
    h, n = S.word_hashes(words)
    assert n.tolist() == [1] * len(words) and len(set(h.tolist())) == len(words)
    of = dict(zip(words, h.tolist(), strict=True))
    for _ in range(50):
        units = [b" " * rng.randrange(9) + b"\t".join(rng.choices(words, k=rng.randrange(9))) for _ in range(rng.randrange(6))]
        h, n = S.word_hashes(units)
        assert h.tolist() == [of[w] for u in units for w in u.split(b"\t" if b"\t" in u else None) for w in w.split()]
        assert n.tolist() == [len(u.split()) for u in units]


def test_bags_from_words_in_any_order_that_keeps_equal_ones_together():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 12, 300)
    h = rng.integers(1, 6, int(n.sum())).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    unit = np.repeat(np.arange(len(n)), n)
    bags, seen = S.word_bags(h, n), {}
    rank = (h >> np.uint64(5) & np.uint64(3)).astype(np.uint8)
    by_rank = S.nth_members(unit, h[S.ordered(unit, h, rank)])
    ends = np.cumsum(n)
    for lo, hi in zip(ends - n, ends, strict=True):
        members = frozenset(bags[lo:hi].tolist())
        assert len(members) == hi - lo and members == frozenset(by_rank[lo:hi].tolist())
        assert seen.setdefault(tuple(sorted(h[lo:hi].tolist())), members) == members
    assert len(set(seen.values())) == len(seen)


def test_members_are_hashed_at_their_places_only(monkeypatch):
    """Lines that nobody asked for are not hashed again, but for few that share the bits of an asked one."""
    texts = [[f"w{i} line {j} of words {i * j % 97}" for j in range(40)] for i in range(500)]
    ids, h = np.arange(500), np.arange(500) * 7919
    asked = [(i, i * 7919, (i * 3 + k) % 40) for i in range(0, 500, 2) for k in range(4)]
    bits = (16 * len(asked)).bit_length()
    marks = np.zeros(1 << bits, bool)
    for at in simjoin.place_bits(*(np.array(x, np.int64) for x in zip(*asked, strict=True)), bits):
        marks[at] = True
    hashed, word_hashes = [], S.word_hashes
    monkeypatch.setattr(S, "word_hashes", lambda units: (hashed.extend(units), word_hashes(units))[1])
    sent = type("Sent", (), {"value": np.packbits(marks)})
    scan = simjoin.scan_members(Taken(), simjoin.lines, None, sent, bits, 1).runs
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h), pa.array(["\n".join(t) for t in texts])], ["id", "h", "text"])
    rows = {r["sid"]: r["members"] for b in scan[0]([batch]) for r in b.to_pylist()}
    want = {texts[i][j].encode() for i, _, j in asked}
    assert want <= set(hashed) and len(hashed) < len(asked) + 0.05 * 20_000
    sets = simjoin.Sets(sorted(want), None)
    assert set(sets.sids.tolist()) <= rows.keys()
    for i, sid in enumerate(sets.sids.tolist()):
        assert sorted(x & (1 << 64) - 1 for x in rows[sid]) == sorted(S.word_bags(*sets.take(np.array([i]))).tolist())
    # a set read at two places, in two batches or in one, stays once
    twice = pa.RecordBatch.from_arrays([pa.array([5, 6, 5]), pa.array([[1], [2], [1]])], ["sid", "members"])
    assert [r["sid"] for b in scan[1]([twice, twice.slice(0, 2)]) for r in b.to_pylist()] == [5, 6]

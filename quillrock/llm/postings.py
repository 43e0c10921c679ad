"""Inverted lists as Arrow blobs: packed by bucket of keys, shuffled as few rows, read back list by list.

An entry says that a set holds a key: (key, sid, own, wide, n, dn, p, linked, heads). own and wide are parities of the set's
members (shingles.parities); n is the set's size; dn that of the part
its keys were taken from, in which the key stands at place p (the set itself, or what it does not share with a
hub); linked says that the set is known to be similar to that hub. A negative p marks the key of a subset:
sets that share it are similar. heads are the first HEADS keys that stand before p, or none: a pair that shares one of them is settled
in that key's list, by pairs or by its hub, so the later lists do not give it again.

Lists of more than LONG_LIST
sets, and lists of more than DENSE sets that would give more than EACH pairs a set, are handed on entry by entry: a
hub takes their pairs' place (simjoin.Joined.rounds). Short lists give their pairs after the filters: length, position, and
parities. A key that is hot within one task's entries leaves that
task as entries as well, spread over all buckets, and a marker tells the key's own bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import shingles as S
from .common import trim

#: For bags, and for sets of shingles, whose members are dearer to compare than a hub is.
LONG_LIST = 512
LONG_LIST_OF_SETS = 128
DENSE = 16
#: Pairs that a list of more than DENSE sets may give, for each of them.
EACH = 8
FLUSH = 400_000
HOLD = 2_000_000
_U = np.uint64
#: Keys before its own that an entry of differences carries.
HEADS = 8
BLOBS = "bucket int, blob binary"
FOUND = "a long, b long, m int, w int, key long, n int"


def need(s, t, pct: int):
    """Least overlap of sets of sizes s and t with 100 * overlap >= pct * union."""
    return -(-pct * (s + t) // (100 + pct))


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that Spark's compression finds the empty ones."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(data: bytes, kind: str, at: int, m: int) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8, m * width, at)
    return np.ascontiguousarray(raw.reshape(width, m).T).view(kind).reshape(-1), at + m * width


def pack(key, sid, own, wide, n, dn, p, linked, heads) -> bytes:
    """Entries sorted by key."""
    steps = np.diff(key >> _U(16), prepend=_U(0))
    return _planes(steps) + sid.tobytes() + own.tobytes() + wide.tobytes() + _planes(n) + _planes(n - dn) + _planes(p) + linked.tobytes() + heads.T.tobytes()


def unpack(data: bytes, width: int = 0) -> tuple[np.ndarray, ...]:
    m = len(data) // (41 + 8 * width)
    steps, at = _unplanes(data, "<u8", 0, m)
    sid = np.frombuffer(data, "<i8", m, at)
    own = np.frombuffer(data, "<u4", m, at + 8 * m)
    wide = np.frombuffer(data, "<u8", m, at + 12 * m)
    n, at = _unplanes(data, "<i4", at + 20 * m, m)
    less, at = _unplanes(data, "<i4", at, m)
    p, at = _unplanes(data, "<i4", at, m)
    return np.cumsum(steps, dtype=np.uint64) << _U(16), sid, own, wide, n, n - less, p, np.frombuffer(data, np.uint8, m, at), np.frombuffer(data, np.uint64, m * width, at + m).reshape(width, m).T


def columns(key, sid, own, wide, n, dn, p, linked, heads=None) -> tuple[np.ndarray, ...]:
    """Of the right types; the low 16 bits of a key are dropped, which can only join two lists."""
    key = np.asarray(key, np.uint64)
    heads = np.zeros((len(key), 0), np.uint64) if heads is None else heads >> _U(16) << _U(16)
    return (key >> _U(16) << _U(16), np.asarray(sid, np.int64), np.asarray(own, np.uint32), np.asarray(wide, np.uint64), np.asarray(n, np.int32), np.asarray(dn, np.int32), np.asarray(p, np.int32), np.asarray(linked, np.uint8), heads)


class Packer:
    """Collects a task's entries and gives them out as rows (bucket, blob); 2 ** bits buckets."""

    def __init__(self, bits: int, long_list: int):
        self.bits, self.long_list, self.parts, self.size = bits, long_list, [], 0

    def add(self, *entry_columns):
        self.parts.append(columns(*entry_columns))
        self.size += len(self.parts[-1][0])
        if self.size >= FLUSH:
            yield self.flush()

    def end(self):
        if self.size:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        key, sid, own, wide, n, dn, p, linked, heads = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(key)
        key, sid, own, wide, n, dn, p, linked, heads = (x[order] for x in (key, sid, own, wide, n, dn, p, linked, heads))
        buckets, blobs = [], []
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = np.diff(np.append(first, len(key)))
        hot = (runs > self.long_list) & (p[first] >= 0)
        if hot.any():  # straight on, in pieces that go to buckets of their own
            rows = np.repeat(hot, runs)
            away = [x[rows] for x in (key, sid, own, wide, n, dn, p, linked, heads)]
            spread = int(sid[0]) & 0xFFFF
            for i, lo in enumerate(range(0, len(away[0]), 8192)):
                buckets.append((1 << self.bits) + (spread + i * 97) % (1 << self.bits))
                blobs.append(pack(*(x[lo : lo + 8192] for x in away)))
            mark = first[hot]
            zero = np.zeros(len(mark), np.int32)
            key, sid, own, wide, n, dn, p, linked, heads = (np.concatenate((x[~rows], y)) for x, y in zip((key, sid, own, wide, n, dn, p, linked, heads), (key[mark], zero.astype(np.int64), zero.astype(np.uint32), zero.astype(np.uint64), zero, zero, zero, zero.astype(np.uint8), np.zeros_like(heads[mark])), strict=True))
            order = np.argsort(key, kind="stable")
            key, sid, own, wide, n, dn, p, linked, heads = (x[order] for x in (key, sid, own, wide, n, dn, p, linked, heads))
        place = (key >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)
        edges = np.append(np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))), len(place)) if len(place) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            buckets.append(int(place[lo]))
            blobs.append(pack(*(x[lo:hi] for x in (key, sid, own, wide, n, dn, p, linked, heads))))
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _pairs_batch(a, b, m, w) -> pa.RecordBatch:
    none = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m.astype(np.int32)), pa.array(w.astype(np.int32)), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32())], ["a", "b", "m", "w", "key", "n"])


def _entries_batch(key, sid, n) -> pa.RecordBatch:
    none = len(key)
    return pa.RecordBatch.from_arrays([pa.array(sid), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.array(key.view(np.int64)), pa.array(n)], ["a", "b", "m", "w", "key", "n"])


class Lists:
    """The lists of one bucket. wanted(n): keys that a pair must share, by the size of its smaller set."""

    def __init__(self, pct: int, wanted, long_list: int, dense: int, each: int, fold: bool, width: int = 0):
        self.pct, self.wanted, self.long_list, self.dense, self.each, self.fold, self.width = pct, wanted, long_list, dense, each, fold, width
        self.clear()

    def clear(self):
        self.parts, self.size, self.limit, self.hot = [], 0, HOLD, np.zeros(0, np.uint64)

    def add(self, blob: bytes):
        self.parts.append(unpack(blob, self.width))
        self.size += len(self.parts[-1][0])
        if self.size >= self.limit:
            yield from self._go(False)

    def end(self):
        if self.size:
            yield from self._go(True)
        self.clear()

    def _go(self, last: bool):
        key, sid, own, wide, n, dn, p, linked, heads = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        marks = sid == 0
        order = self._order(key, sid, n)
        if marks.any():
            self.hot = np.union1d(self.hot, key[marks])
            order = order[~marks[order]]
        # only key and set are read of all entries, the rest of those in lists of two or more
        key, sid = key[order], sid[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        order, key = order[fresh], key[fresh]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        c = np.diff(np.append(first, len(key)))
        hot = np.isin(key[first], self.hot)
        if last:
            keep = (c > 1) | hot
            rows = np.repeat(keep, c)
            order, key, c, hot = order[rows], key[rows], c[keep], hot[keep]
            first = np.cumsum(c) - c
        sid = sid[fresh][rows] if last else sid[fresh]
        own, wide, n, dn, p, linked, heads = (x[order] for x in (own, wide, n, dn, p, linked, heads))
        long = ((c > self.long_list) & (p[first] >= 0)) | hot
        if not last:  # keep what is not long yet; memory holds few entries of a hot key
            self.hot = np.union1d(self.hot, key[first[long]])
            rows = np.repeat(long, c)
            if rows.any():
                yield _entries_batch(key[rows], sid[rows], n[rows])
            self.parts = [tuple(x[~rows] for x in (key, sid, own, wide, n, dn, p, linked, heads))]
            self.size = int((~rows).sum())
            self.limit = self.size + HOLD
            return
        sub = (p[first] < 0) & (c > 1)
        if sub.any():
            yield from self._subsets(*(x[np.repeat(sub, c)] for x in (key, sid, n, p)))
        use = (c > 1) & ~long & ~sub
        rows = np.flatnonzero(np.repeat(use, c))
        if len(rows):
            run = np.repeat(np.arange(int(use.sum())), c[use])
            dense = yield from self._pairs(run, c[use], *(x[rows] for x in (key, sid, own, wide, n, dn, p, linked, heads)))
            long[np.flatnonzero(use)[dense]] = True
        rows = np.repeat(long, c)
        if rows.any():
            yield _entries_batch(key[rows], sid[rows], n[rows])

    def _order(self, key, sid, n):
        """By (key, n, sid): one sort of key and n together, as the last 16 bits of a key are empty."""
        both = key | np.minimum(n, 0xFFFF).astype(np.uint64)
        order = np.argsort(both)
        sorted_both = both[order]
        same = np.zeros(len(order), bool)
        same[1:] = sorted_both[1:] == sorted_both[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        order[tied] = order[tied][np.lexsort((sid[order[tied]], n[order[tied]], sorted_both[tied]))]
        return order

    def _subsets(self, key, sid, n, p):
        """A key belongs to one pair of sizes, s and t: a set of s members links with the least set of t, and the other way."""
        t = -1 - p
        order = np.lexsort((sid, n, key))
        key, sid, n, t = key[order], sid[order], n[order], t[order]
        head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (n[1:] != n[:-1]))))
        least = {(int(key[i]), int(n[i])): int(sid[i]) for i in head}
        other = [least.get(x) for x in zip(key.tolist(), t.tolist(), strict=True)]
        pairs = {(min(x, y), max(x, y)) for x, y in zip(sid.tolist(), other, strict=True) if y is not None and x != y}
        if pairs:
            a, b = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
            yield _pairs_batch(a, b, np.ones(len(a)), np.ones(len(a)))

    def _pairs(self, run, c, key, sid, own, wide, n, dn, p, linked, heads):
        """Pairs of short lists, by distance in the list, sorted by size: where a pair differs too much in size, wider ones do as well.

        Returns which runs are dense; those give no pairs.
        """
        made, dense = np.zeros(len(c), np.int64), np.zeros(len(c), bool)
        # sets behind each of its list that are not too large for it
        at, span = np.arange(len(run)), int(n.max()) + 1
        reach = np.searchsorted(run * span + n, run * span + np.minimum(100 * n.astype(np.int64) // self.pct, span - 1), "right") - 1 - at
        alive, step, got = at, 0, []
        most = np.where(c > self.dense, self.each * c, np.iinfo(np.int64).max)
        behind = dn - p
        while len(alive):
            step += 1
            alive = alive[reach[alive] >= step]
            if dense.any():
                alive = alive[~dense[run[alive]]]
            i, j = alive, alive + step
            n1, n2 = n[i].astype(np.int64), n[j].astype(np.int64)
            most_apart = n1 + n2 - 2 * need(n1, n2, self.pct)
            w = self.wanted(n1)
            ok = (p[i] + p[j] + np.abs(behind[i] - behind[j]) - 2 * (w - 1) <= most_apart) & ((linked[i] & linked[j]) == 0)
            i, j, w, n1, n2, most_apart = (x[ok] for x in (i, j, w, n1, n2, most_apart))
            ok = S.apart(own[i], own[j], n1, n2, wide[i], wide[j], self.fold) <= most_apart
            i, j, w = i[ok], j[ok], w[ok]
            if self.width and len(i):
                fresh = ~self._met(key[i], heads[i], heads[j])
                i, j, w = i[fresh], j[fresh], w[fresh]
            if len(i):
                made += np.bincount(run[i], minlength=len(c))
                got.append((run[i], sid[i], sid[j], w))
                dense |= made > most
        if got:
            r, x, y, w = (np.concatenate(z) for z in zip(*got, strict=True))
            keep = ~dense[r]
            a, b, w = np.minimum(x, y)[keep], np.maximum(x, y)[keep], w[keep]
            if len(a):
                order = np.lexsort((b, a))
                a, b, w = a[order], b[order], w[order]
                head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                yield _pairs_batch(a[head], b[head], np.diff(np.append(head, len(a))), np.minimum.reduceat(w, head))
        return dense

    @staticmethod
    def _met(key, a, b):
        """Whether two entries of a key share an earlier one; 0 stands for none."""
        met = np.zeros(len(key), bool)
        for x in range(a.shape[1]):
            at = a[:, x]
            met |= (at != 0) & (at != key) & (b == at[:, None]).any(1)
        return met


def read_lists(pct: int, wanted, bits: int, long_list: int, dense: int, each: int, fold: bool, width: int = 0):
    """For mapInArrow over rows (bucket, blob) sorted by bucket: FOUND rows, pairs (key null) or entries of long lists (a is the set)."""

    def run(batches):
        lists, now = Lists(pct, wanted, long_list, dense, each, fold, width), -1
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    yield from lists.end()
                    now = bucket
                if bucket >> bits:  # entries of a hot key pass
                    key, sid, _, _, n, *_ = unpack(blob.as_buffer(), width)
                    yield _entries_batch(key, sid, n)
                else:
                    yield from lists.add(blob.as_buffer())
        yield from lists.end()
        trim()

    return run

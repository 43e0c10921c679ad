"""Vectorised word shingling and a fixed-size rarity sketch, run inside Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

SKETCH_BITS = 23
SKETCH_CHUNKS = 32
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


#: Bytes hashed at a time: few enough for a core's cache.
_BLOCK = 1 << 17
#: The first 0 to 8 bytes of a number.
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _eight(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n bytes (8 at most) from each place on, as a number; data: as whole numbers of 8 bytes, with one more behind."""
    low, shift = at >> 3, (at & 7).astype(np.uint64) << _U(3)
    return (data[low] >> shift | data[low + 1] << _U(1) << (_U(63) - shift)) & _HEAD[np.minimum(n, 8)]


def word_hashes(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all units in order, and the number of words of each unit.

    Words are runs of anything but ASCII white space. A hash mixes the word's length and its first eight bytes; words of
    the same length up to eight never share one. A longer word's further eights, each mixed with its place, are added and mixed
    in. Blocks of about _BLOCK bytes (or one longer word) bound the memory.
    """
    text = b"\n".join(units) + b"\n"
    text += b"\n" * (8 + -len(text) % 8)
    data, eights = np.frombuffer(text, np.uint8), np.frombuffer(text, "<u8")
    solid = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    unit_ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1)
    lens = np.diff(np.searchsorted(starts, unit_ends), prepend=0)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _BLOCK, "right")))
        at = starts[lo:hi]
        size = ends[lo:hi] - at
        h = mix(_eight(eights, at, size) ^ size.astype(np.uint64) * _U(0xA0761D6478BD642F))
        long = np.flatnonzero(size > 8)
        if len(long):
            more = size[long] - 1 >> 3
            first = np.cumsum(more) - more
            nth = np.arange(int(more.sum())) - np.repeat(first, more) + 1
            rest = _eight(eights, np.repeat(at[long], more) + 8 * nth, np.repeat(size[long], more) - 8 * nth)
            rest = mix(mix(rest + _U(0x632BE59BD9B4E019)) + nth.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
            h[long] = mix(h[long] + np.add.reduceat(rest, first) * _U(0x9E3779B97F4A7C15))
        out[lo:hi] = h
        lo = hi
    return out, lens


def ordered(unit: np.ndarray, h: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """The order by (unit, count, h), units from 0 and counts of one byte: one sort of a 64-bit prefix of the three.

    Where different hashes of a unit share the prefix, all three are sorted in full.
    """
    if not len(unit):
        return np.zeros(0, np.int64)
    bits = int(unit.max()).bit_length() + (8 if count is not None else 0)
    lead = unit.astype(np.uint64) if count is None else unit.astype(np.uint64) << _U(8) | count
    key = h if not bits else lead << _U(64 - bits) | h >> _U(bits)
    order = np.argsort(key)
    key, sorted_h = key[order], h[order]
    if ((key[1:] == key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
        return np.lexsort((h, unit) if count is None else (h, count, unit))
    return order


def shingle_sets(units: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each unit, joined, and offsets (len(units) + 1).

    A unit with fewer than k words, but at least one, has its whole word sequence as its only shingle;
    one without words has none.
    """
    flat, lens = word_hashes(units)
    total = len(flat)
    starts = np.cumsum(lens) - lens
    counts = np.maximum(lens - (k - 1), 0)
    if total >= k:
        roll = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            roll = roll * _U(0xD6E8FEB86659FD93) + flat[j : total - k + 1 + j]
        roll = mix(roll)
    else:
        roll = np.zeros(0, np.uint64)
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    where = np.arange(n) - np.repeat(first, counts) + np.repeat(starts, counts)
    h, unit = roll[where], np.repeat(np.arange(len(lens)), counts)
    short = np.flatnonzero((lens > 0) & (lens < k))
    if len(short):
        own = lens[short].astype(np.uint64) * _U(0xA0761D6478BD642F)
        for j in range(k - 1):
            on = lens[short] > j
            own[on] = own[on] * _U(0xD6E8FEB86659FD93) + flat[starts[short][on] + j]
        h, unit = np.concatenate((h, mix(own))), np.concatenate((unit, short))
    order = ordered(unit, h)
    h, unit = h[order], unit[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])
    h, unit = h[fresh], unit[fresh]
    return h, np.concatenate(([0], np.cumsum(np.bincount(unit, minlength=len(lens))))).astype(np.int64)


def nth_members(unit: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Members of bags of word hashes whose equal words stand together: a word's first is the word, each later one a member of its own."""
    again = np.flatnonzero((h[1:] == h[:-1]) & (unit[1:] == unit[:-1])) + 1
    if not len(again):
        return h
    head = np.concatenate(([True], np.diff(again) > 1))
    nth = np.arange(len(again)) - np.maximum.accumulate(np.where(head, np.arange(len(again)), 0)) + 1
    out = h.copy()
    out[again] = mix(h[again] + nth.astype(np.uint64) * _U(0xA0761D6478BD642F))
    return out


def word_bags(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Members of the bags of word hashes, in order of their words."""
    unit = np.repeat(np.arange(len(lens)), lens)
    return nth_members(unit, flat[ordered(unit, flat)])


#: Parities of a set's members by hash: over OWN slots for every set, and over 64 further ones for sets of WIDE members or more.
OWN = 32
WIDE = 40


_AT = np.arange(OWN + 64)
_NEAR = np.where(_AT < OWN, _U(1) << (_AT % 64).astype(np.uint64), _U(0))
_FURTHER = np.where(_AT >= OWN, _U(1) << ((_AT - OWN) % 64).astype(np.uint64), _U(0))


def set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of all members of each set, or of each bag of words in any order; 0 for an empty set only.

    It mixes two sums of differently mixed members with their number; repeated members count, so a bag needs no sorting.
    """
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        m = mix(h + _U(0x632BE59BD9B4E019))
        at = offsets[:-1][full]
        s, x = np.add.reduceat(m, at), np.add.reduceat((m ^ m >> _U(29)) * _U(0xA0761D6478BD642F), at)
        ids = mix(mix(s) * _U(0x9E3779B97F4A7C15) + (x ^ n[full].astype(np.uint64)))
        out[full] = np.where(ids == 0, _U(1), ids)
    return out.view(np.int64)


def parities(h: np.ndarray, n: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Parities (own, further) of sets of n members each, h in order: bits that say whether an odd number falls on a slot.

    Two sets differ in at least as many members as bits (`apart`). With fold, sets below WIDE have their further
    parities folded into their own.
    """
    own, more = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        m = mix(h + _U(0x632BE59BD9B4E019))
        slot = ((m >> _U(32)) * _U(OWN + 64) >> _U(32)).astype(np.int64)
        at = (np.cumsum(n) - n)[full]
        own[full], more[full] = np.bitwise_xor.reduceat(_NEAR[slot], at), np.bitwise_xor.reduceat(_FURTHER[slot], at)
    if fold:
        small = n < WIDE
        own[small] ^= more[small] & _U((1 << OWN) - 1) ^ more[small] >> _U(OWN)
        more[small] = 0
    return own.astype(np.uint32), more


def apart(ox: np.ndarray, oy: np.ndarray, nx: np.ndarray, ny: np.ndarray, wx: np.ndarray, wy: np.ndarray, fold: bool) -> np.ndarray:
    """Members, at least, in which sets differ, by their parities and sizes; folded ones compare with folded ones only."""
    bits = np.bitwise_count(ox ^ oy).astype(np.int64) + np.bitwise_count(wx ^ wy)
    return np.where((nx >= WIDE) == (ny >= WIDE), bits, 0) if fold else bits


class Sketch:
    """One-row counting sketch of fixed size over members; a task's counts stop at 65,535, sums do not.

    In a corpus of many times more members than counters, every counter stands on a background; then only members
    well above it are known as common. The order of members changes the length of lists, never a result.
    """

    def __init__(self):
        self.counts = np.zeros(1 << SKETCH_BITS, np.uint32)

    def add(self, h: np.ndarray) -> None:
        np.add.at(self.counts, (h >> _U(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))

    def chunks(self):
        for i, part in enumerate(np.split(self.counts, SKETCH_CHUNKS)):
            if part.any():
                yield i, zlib.compress(np.minimum(part, 65535).astype(np.uint16).tobytes(), 1)


def merge_sketches(batches):
    """Sum the chunks that reach this task; memory is the sketch's size whatever the number of rows."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(z), np.uint16)
            sums[i] = sums[i] + part if i in sums else part.astype(np.uint64)
    for i, v in sums.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "z": pa.array([zlib.compress(rank_of(v).tobytes(), 1)], pa.binary())})


def rank_of(counts: np.ndarray) -> np.ndarray:
    """One byte a count: exact up to 32, then in steps of an eighth of an octave, up to some 8 billion."""
    return np.where(counts <= 32, counts, np.minimum(32 + 8 * np.log2(np.maximum(counts, 1) / 32), 255)).astype(np.uint8)


def count_of(ranks: np.ndarray) -> np.ndarray:
    """About the count of each rank."""
    return np.where(ranks <= 32, ranks, 32 * 2.0 ** ((ranks.astype(float) - 32) / 8))


def rank_at(h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return ranks[(h >> _U(64 - SKETCH_BITS)).astype(np.int64)]


def sketch_array(rows) -> np.ndarray:
    """Ranks of all counters; 8 MB whatever the corpus."""
    out = np.zeros((SKETCH_CHUNKS, (1 << SKETCH_BITS) // SKETCH_CHUNKS), np.uint8)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["z"]), np.uint8)
    return out.reshape(-1)

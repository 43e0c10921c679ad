"""Exact Jaccard joins of sets (word shingles) or bags (words of a line): the engine of the n-gram join and of line dedup.

Flow, for units (documents or lines) given as texts:

1. a scan hashes every unit and writes (unit, set id, set size) and a fixed-size rarity sketch;
2. a scan orders each set's members by (sketched rarity, hash) and packs a prefix of them as entries of inverted
   lists - long enough that a pair at or above the threshold shares one entry, or SHARED entries for all but
   short sets - or, for sets below the boundary, all subsets of the fixed size (postings.py);
3. short lists give pairs by the length and positional filters. Long or dense lists give none: one set of each
   is its hub, every other set of the list is verified against it, and what a set does not share with the hub is
   ordered and packed again. If two sets are similar and one of them is not similar to the hub, they differ
   from it in a common member (below), so a prefix of these differences finds them. Lists get shorter by their
   hub and by what it joins until none is left: a group of n near copies costs some n pairs a round;
4. a scan gathers the members of the sets in pairs and long lists, at one place of each, found by a bitmap (wrong hits
   of the bitmap cost rows, never results), and pairs are verified by counting the intersection.

Why the differences suffice: write X and Y for what sets x and y do not share with the hub h. Then x and y differ
in X xor Y. If X and Y had no common member, the Jaccard distance of x and y would be at least that of y and h,
as |Y| <= |h| + |y|; so a pair that is similar while y and h are not has a common member in X and Y, and the first
one in any order stands behind at most as many others in either as x and y may differ.

For bags a prefix entry that is common is no key of its own: it is joined with each later entry of the prefix,
which is then one longer (`word_keys`), and one shared key makes a candidate.

Any total order of members gives whole results; rarity only makes the lists short. Equal sets have one id and
are never paired. Ids, members and keys are 64-bit hashes.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings as P
from . import shingles as S
from .common import Scratch, slices, split_join, trim
from .postings import need

_SEEN = 200_000
#: (least size, entries): sets of so many members are candidates only if they share so many prefix entries.
SHARED = ((96, 8), (24, 3), (0, 1))
#: Rank (shingles.rank_of) of 512 uses: a word counted more often is common; bags of LONG members or more have single words as keys, however common.
RARE = 64
LONG = 120
MANY_WORDS = 3
#: Keys for each word of the corpus from which they are packed in several passes; some 26 bytes a key are shuffled.
KEYS_A_WORD = 0.25
#: Entries aimed at in a bucket of lists.
PER_BUCKET = 64_000


def shared(n):
    """Entries that a pair must share, by the size of its smaller set; n: int or array."""
    return np.select([n >= at for at, _ in SHARED], [m for _, m in SHARED])


def one(n):
    return np.ones_like(n)


def shared_words(n, pct: int):
    """The same for bags: where neither bag of a pair has keys of two words, they must share MANY_WORDS single ones."""
    return np.where(pct * n >= 100 * LONG, MANY_WORDS, 1)


def whole(text: bytes | None) -> list[bytes]:
    return [(text or b"").lower()]


def lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _units(batch, cut):
    """Of each unit the row and the number in it, and its bytes."""
    row, no, units = [], [], []
    for i, t in enumerate(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()):
        parts = cut(t)
        units += parts
        row += [i] * len(parts)
        no += range(len(parts))
    return row, no, units


class Sets:
    """The sets (k-word shingles) or bags (k None) of a batch of units; a bag is sorted only where it is asked for."""

    def __init__(self, units: list[bytes], k: int | None):
        self.k = k
        if k is None:
            self.h, lens = S.word_hashes(units)
            self.offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
        else:
            self.h, self.offsets = S.shingle_sets(units, k)
        self.sids, self.n = S.set_ids(self.h, self.offsets), np.diff(self.offsets)

    def take(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words or shingles of the units of `use`, and sizes."""
        n = self.n[use]
        first = np.cumsum(n) - n
        return self.h[np.arange(int(n.sum())) + np.repeat(self.offsets[:-1][use] - first, n)], n


class Fresh:
    """Sets that this task has not just seen; how many it remembers is bounded, so a set may come again."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, sids: np.ndarray, at: np.ndarray) -> np.ndarray:
        use, seen = [], self.seen
        for i, sid in zip(at.tolist(), sids[at].tolist(), strict=True):
            if sid not in seen:
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sid)
                use.append(i)
        return np.array(use, np.int64)


def scan_units(df: DataFrame, cut, k: int | None) -> DataFrame:
    """df: (id, h, text). One row per unit, and the rows of the sketch (chunk not null)."""

    def run(batches):
        sketch = S.Sketch()
        for b in slices(batches):
            row, no, units = _units(b, cut)
            sets = Sets(units, k)
            sketch.add(sets.h)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(no, pa.int32()), pa.array(sets.sids), pa.array(sets.n.astype(np.int32)), pa.nulls(len(no), pa.int32()), pa.nulls(len(no), pa.binary())],
                ["id", "h", "unit", "sid", "n", "chunk", "z"],
            )
        for i, z in sketch.chunks():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([i], pa.int32()), pa.array([z], pa.binary())],
                ["id", "h", "unit", "sid", "n", "chunk", "z"],
            )
        del sketch
        trim()

    return df.select("id", "h", "text").mapInArrow(run, "id long, h long, unit int, sid long, n int, chunk int, z binary")


def read_sketch(scanned: DataFrame) -> np.ndarray:
    """Summed in the executors; the driver gets SKETCH_CHUNKS rows, 8 MB whatever the corpus."""
    rows = scanned.where("chunk is not null").select("chunk", "z").repartition(8, "chunk").mapInArrow(S.merge_sketches, "chunk int, z binary")
    return S.sketch_array(rows.collect())


def subset_count(n: int, pct: int, boundary: int) -> int:
    """Signatures of a set of n members below the boundary."""
    return sum(comb(n, need(min(n, t), max(n, t), pct)) for t in range(1, boundary + 1) if 100 * min(n, t) >= pct * max(n, t))


def choose_boundary(ranks: np.ndarray, pct: int, most: int = 24) -> int:
    """Largest size up to which enumerating subsets costs no more than scanning the inverted lists.

    A scanned set of n members costs its prefix, times the mean length of a list in excess of the
    sketch's background, plus a verification of n members.
    """
    n = np.bincount(ranks, minlength=256)[1:].astype(float)
    if not n.sum():
        return 0
    count = S.count_of(np.arange(1, 256))
    middle = max(1.0, count[np.searchsorted(np.cumsum(n), n.sum() / 2)])
    length = 1 + max(0.0, (n * count**2).sum() / (n * count).sum() - middle) / middle
    best = 0
    for n in range(1, most + 1):
        prefix = n - need(n, -(-pct * n // 100), pct) + 1
        if subset_count(n, pct, n) > prefix * min(length, 64.0) + n:
            break
        best = n
    return best


def subset_keys(members: np.ndarray, pct: int, boundary: int) -> list[tuple[int, int]]:
    """(key, -1 - partner's size) of all subsets of one set of at most `boundary` members that a partner may share."""
    n, out = len(members), []
    listed = [m.tobytes() for m in np.sort(members)]
    for t in range(1, boundary + 1):
        s, l = min(n, t), max(n, t)
        if 100 * s >= pct * l:
            head = bytes((s, l))
            out += [(xxhash.xxh3_64_intdigest(head + b"".join(c)), -1 - t) for c in combinations(listed, need(s, l, pct))]
    return out


def word_keys(h: np.ndarray, count: np.ndarray, place: np.ndarray, n: np.ndarray, pct: int, rare: int):
    """(key, index of its first entry) of bags of words in order of rarity; n: each entry's bag's size.

    Bags of n members can miss d = n - ceil(pct * n / 100) of a partner's, so the first shared entry is among
    the first d + 1 and the second among the first d + 2. Bags that may meet shorter and longer ones than
    LONG have both kinds of keys; those that meet none with keys of two words have
    MANY_WORDS - 1 more. Two shared entries are sure if pct > 50 and no bag has pct * (n + 1) > 100 * n.
    """
    d = n - -(-pct * n // 100)
    single = np.flatnonzero((place < d + shared_words(n, pct)) & ((count <= rare) | (n >= LONG)))
    two = np.flatnonzero((place <= d) & (count > rare) & (pct * n < 100 * LONG))
    times = (d - place)[two] + 1
    i = np.repeat(two, times)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    pair = S.mix(h[i] * np.uint64(0xD6E8FEB86659FD93) + h[j])
    return np.concatenate((h[single], pair)), np.concatenate((single, i))


def mean_keys(n: np.ndarray, pct: int, ranks: np.ndarray, rare: int) -> np.ndarray:
    """Mean keys of bags of n words, each rare with the chance of the corpus: what rare words leave of a bag's prefix is common, and its keys grow with its square."""
    uses = np.bincount(ranks, minlength=256) * S.count_of(np.arange(256))
    chance = uses[1 : rare + 1].sum() / max(1.0, uses[1:].sum())
    prefix = n - -(-pct * n // 100) + 1
    out = (prefix + MANY_WORDS).astype(float)
    of = np.ones(1)  # chances that a bag has 0, 1, ... rare words
    for size in np.unique(n[pct * n < 100 * LONG]).tolist():
        while len(of) <= size:
            of = np.append(of * (1 - chance), 0) + np.append(0, of * chance)
        rares, first = np.arange(size + 1), size - -(-pct * size // 100) + 1
        single = first + MANY_WORDS if size >= LONG else np.minimum(first, rares)
        two = np.maximum(0, first - rares)
        out[n == size] = (of * (single + two * (two + 1) / 2)).sum()
    return out


def scan_keys(df: DataFrame, cut, k: int | None, pct: int, rarity, boundary: int, least: int, bits: int, long_list: int, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Packed entries of every distinct set of at least `least` members; part (i, m): of the keys whose remainder by m is i."""
    rare = RARE

    def mine(key) -> np.ndarray:
        return np.flatnonzero((np.asarray(key, np.uint64) >> np.uint64(16)) % np.uint64(part[1]) == np.uint64(part[0]))

    def run(batches):
        ranks, fresh, packer = rarity.value, Fresh(), P.Packer(bits, long_list)
        for b in slices(batches):
            sets = Sets(_units(b, cut)[2], k)
            use = fresh(sets.sids, np.flatnonzero(sets.n >= max(1, least)))
            for i in use[sets.n[use] <= boundary].tolist():
                keys = subset_keys(sets.h[sets.offsets[i] : sets.offsets[i + 1]], pct, boundary)
                if keys:
                    key, p = (np.array(x, t) for x, t in zip(zip(*keys, strict=True), (np.uint64, np.int64), strict=True))
                    key, p = key[mine(key)], p[mine(key)]
                    m, n = len(key), int(sets.n[i])
                    yield from packer.add(key, np.full(m, sets.sids[i]), np.zeros(m), np.zeros(m), np.full(m, n), np.full(m, n), p, np.zeros(m))
            # sets of the boundary that may have a partner above it are listed as well
            use = use[100 * (sets.n[use]) >= pct * (boundary + 1)]
            if not len(use):
                continue
            h, n = sets.take(use)
            unit = np.repeat(np.arange(len(use)), n)
            rank = S.rank_at(h, ranks)
            own, wide = S.parities(h, n)
            if k is not None:  # sets of shingles are too large for further parities to tell them apart
                wide[:] = 0
            order = S.ordered(unit, h, rank)
            h = h[order] if k is not None else S.nth_members(unit, h[order])
            # the first ones of each, which have the keys
            most = np.minimum(n, n - -(-pct * n // 100) + (MANY_WORDS + 1 if k is None else shared(n)))
            first = np.cumsum(most) - most
            place = np.arange(int(most.sum())) - np.repeat(first, most)
            at = place + np.repeat(np.cumsum(n) - n, most)
            h, rank, unit = h[at], rank[order[at]], unit[at]
            if k is None:
                key, at = word_keys(h, rank, place, n[unit], pct, rare)
            else:
                key, at = h, np.arange(len(h))
            own_part = mine(key)
            key, at = key[own_part], at[own_part]
            size = n[unit[at]]
            yield from packer.add(key, sets.sids[use][unit[at]], own[unit[at]], wide[unit[at]], size, size, place[at], np.zeros(len(at)))
        yield from packer.end()
        del packer, fresh
        trim()

    return df.select("text").mapInArrow(run, P.BLOBS)


def place_bits(ids: np.ndarray, h: np.ndarray, unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits, of 2 ** bits, of each unit's place; a null id stands as 0."""
    at = S.mix(h.view(np.uint64) + S.mix(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) + unit.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (at >> np.uint64(64 - bits)).astype(np.int64), (at & np.uint64((1 << bits) - 1)).astype(np.int64)


def build_bitmap(places: DataFrame, bits: int, chunks: int = 64) -> np.ndarray:
    """Two bits per place (id, h, unit), put together in the executors."""
    per = (1 << bits) // chunks

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.concatenate(place_bits(*(b.column(i).fill_null(0).to_numpy() for i in range(3)), bits))
            chunk = at // per
            for c in np.unique(chunk).tolist():
                if c not in found:
                    found[c] = np.zeros(per, bool)
                found[c][at[chunk == c] % per] = True
        for c, v in found.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "z": pa.array([np.packbits(v).tobytes()], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(z, np.uint8)
                sums[c] = sums[c] | v if c in sums else v
        for c, v in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "z": pa.array([v.tobytes()], pa.binary())})

    out = np.zeros((chunks, per // 8), np.uint8)
    for r in places.select("id", "h", "unit").mapInArrow(run, "chunk int, z binary").repartition(8, "chunk").mapInArrow(merge, "chunk int, z binary").collect():
        out[r["chunk"]] |= np.frombuffer(r["z"], np.uint8)
    return out.reshape(-1)


def marked(members: DataFrame, sids: DataFrame, bits: int) -> DataFrame:
    """The rows (sid, members) of the sets of sids, and few others, by a bitmap: nothing is shuffled."""
    marks = members.sparkSession.sparkContext.broadcast(build_bitmap(sids.select(F.col("sid").alias("id"), F.col("sid").alias("h"), F.lit(0).alias("unit")), bits))

    def run(batches):
        z = marks.value
        for b in batches:
            sid, hit = b.column(0).to_numpy(), np.ones(len(b), bool)
            for at in place_bits(sid, sid, np.zeros(len(b), np.int64), bits):
                hit &= (z[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            yield b.filter(pa.array(hit))

    return members.mapInArrow(run, "sid long, members array<long>")


def scan_members(df: DataFrame, cut, k: int | None, bitmap, bits: int, least: int) -> DataFrame:
    """(sid, members) of the sets at the places whose bits are set; only their units are hashed."""

    def run(batches):
        marks, fresh = bitmap.value, Fresh()
        for b in slices(batches):
            row, no, units = _units(b, cut)
            row = np.array(row, np.int64)
            hit = np.ones(len(row), bool)
            for at in place_bits(b.column(0).fill_null(0).to_numpy()[row], b.column(1).to_numpy()[row], np.array(no, np.int64), bits):
                hit &= (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            sets = Sets([units[i] for i in np.flatnonzero(hit).tolist()], k)
            use = fresh(sets.sids, np.flatnonzero(sets.n >= max(1, least)))
            if len(use):
                h, n = sets.take(use)
                h = S.word_bags(h, n) if k is None else h
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sets.sids[use]), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["sid", "members"])
        trim()

    def once(batches):
        seen: set[int] = set()
        for b in batches:
            sids, at = np.unique(b.column(0).to_numpy(), return_index=True)
            at = [i for i, sid in zip(at.tolist(), sids.tolist(), strict=True) if sid not in seen]
            seen.update(sids.tolist())
            if at:
                yield b if len(at) == len(b) else b.take(pa.array(at))

    kind = "sid long, members array<long>"
    return df.select("id", "h", "text").mapInArrow(run, kind).repartition("sid").mapInArrow(once, kind)


def differences(rarity, pct: int, bits: int, long_list: int):
    """For mapInArrow over (a, b, ma, mb), b the hub: rows (a, b) where they are similar, and entries of what a does not share with b."""

    def run(batches):
        ranks, packer = rarity.value, P.Packer(bits, long_list)
        out = ["a", "b", "bucket", "blob"]

        def blobs(found):
            for x in found:
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, x.column(0), x.column(1)], out)

        for batch in batches:
            near = []
            for i in range(len(batch)):
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ma, mb = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in (2, 3))
                d = np.setxor1d(ma, mb, assume_unique=True)
                na, nb = len(ma), len(mb)
                o = (na + nb - len(d)) // 2
                linked = 100 * o >= pct * (na + nb - o)
                if linked:
                    near.append((a, b))
                t = 100 * na // pct
                most = na + t - 2 * need(na, t, pct) + 2
                order = np.lexsort((d, S.rank_at(d, ranks), np.isin(d, mb, assume_unique=True)))[: most + 1]
                m = len(order)
                key = S.mix(d[order] + np.uint64(b * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                (own,), (wide,) = S.parities(ma, np.array([na]), fold=False)
                heads = np.where(np.arange(P.HEADS) < np.arange(m)[:, None], np.resize(key, P.HEADS), 0) if m else None
                yield from blobs(packer.add(key, np.full(m, a), np.full(m, own), np.full(m, wide), np.full(m, na), np.full(m, len(d)), np.arange(m), np.full(m, linked), heads))
            if near:
                x, y = zip(*near, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary())], out)
        yield from blobs(packer.end())
        trim()

    return run


#: First bits of a member by which pairs are compared before whole members are shuffled.
BRIEF = 16


def may_reach(pct: int):
    """For mapInArrow over (a, b, ma, mb), of each member its first BRIEF bits: the pairs (a, b) that may be similar.

    Sets share at most as many members as first bits, repeated ones as often as both hold them, so no similar pair is lost.
    Members of bags come in another order, and are sorted here.
    """

    def counted(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Row, first bits and how often they stood before, in one number for each member; sizes of the rows."""
        n = np.diff(column.offsets.to_numpy())
        at = np.sort(np.repeat(np.arange(len(n)), n) << BRIEF | column.flatten().to_numpy().view(np.uint16), kind="stable")
        place = np.arange(len(at))
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1]
        return at << 32 | place - np.maximum.accumulate(np.where(fresh, place, 0)), n

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                b = batch.slice(lo, 1000)
                (x, nx), (y, ny) = (counted(b.column(c)) for c in (2, 3))
                o = np.bincount(np.intersect1d(x, y, assume_unique=True) >> 32 + BRIEF, minlength=len(b))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(100 * o >= pct * (nx + ny - o)))

    return run


#: Sets, and lists, up to which their order is broadcast, 16 bytes each; beyond it they are joined.
ORDERED = 2_000_000
#: Sets up to which their ids are broadcast to find their members, some 60 bytes each; beyond it a bitmap of them is.
FEW = 1_000_000


def _map_of(df: DataFrame, column: str):
    """Two arrays, the values of `column` sorted and their other column."""
    got = df.toPandas()
    keys, values = got[column].to_numpy(), got[got.columns[1] if got.columns[0] == column else got.columns[0]].to_numpy()
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def hub_pairs(long: DataFrame, order: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): b the hub of a list of long (key, sid, n), its first set by `order` (sid, o); a another set of it."""
    sc = long.sparkSession.sparkContext
    order = scratch.table(order, f"order{name}")
    if order.count() > ORDERED:
        hub = order.join(long, "sid").groupBy("key").agg(F.min(F.struct("o", "sid")).alias("f")).select("key", F.col("f.sid").alias("b"))
        return split_join(long.select("key", F.col("sid").alias("a")), hub, "key", F.col("a")).where("a <> b").select("a", "b").distinct()
    sids = order.orderBy("o", "sid").select("sid").toPandas()["sid"].to_numpy()
    by_sid = np.argsort(sids, kind="stable")
    sent = sc.broadcast((sids, sids[by_sid], by_sid))

    def least(batches):
        _, named, rank = sent.value
        for b in batches:
            key, r = b.column(0).to_numpy(), rank[np.searchsorted(named, b.column(1).to_numpy())]
            at = np.lexsort((r, key))
            at = at[np.concatenate(([True], np.diff(key[at]) != 0))] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(r[at].astype(np.int32))], ["key", "r"])

    hubs = scratch.table(long.select("key", "sid").mapInArrow(least, "key long, r int").groupBy("key").agg(F.min("r").alias("r")), f"hubs{name}")
    if hubs.count() > ORDERED:
        named = long.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(sids.tolist())], "r int, b long")
        hub = hubs.join(named, "r").select("key", "b")
        return split_join(long.select("key", F.col("sid").alias("a")), hub, "key", F.col("a")).where("a <> b").select("a", "b").distinct()
    lists = sc.broadcast(_map_of(hubs, "key"))

    def pairs(batches):
        keys, first = lists.value
        names = sent.value[0]
        for b in batches:
            a = b.column(1).to_numpy()
            hub = names[first[np.searchsorted(keys, b.column(0).to_numpy())]]
            both = np.unique(np.stack((a, hub), 1)[a != hub], axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    return long.select("key", "sid").mapInArrow(pairs, "a long, b long").distinct()


class Joined:
    """The units and, after `rounds`, the links found by hubs (`near`) and the candidate pairs still to verify (`pairs`).

    `wanted` are the sets in long lists or pairs.
    hubs: given a table (key, sid, n) of the sets of long lists, their order (sid, o): the first of a list is its hub.
    places: gives of each set of `wanted` one place, (sid, first), where it can be read; first is (id, h, unit).
    """

    def __init__(self, df: DataFrame, scratch: Scratch, cut, k: int | None, pct: int, least: int = 1, boundary: int | None = None):
        self.df, self.scratch, self.cut, self.k, self.pct, self.least = df, scratch, cut, k, pct, least
        self.spark, self.long_list, self.dense = df.sparkSession, P.LONG_LIST if k is None else P.LONG_LIST_OF_SETS, P.DENSE
        scanned = scratch.table(scan_units(df, cut, k), "units")
        ranks = read_sketch(scanned)
        self.units = scanned.where("chunk is null").drop("chunk", "z")
        self.boundary = choose_boundary(ranks, pct) if boundary is None else boundary
        self.rarity = self.spark.sparkContext.broadcast(ranks)
        sizes = self.units.groupBy("n").agg(F.count(F.lit(1)).alias("c")).toPandas()
        n, c = sizes["n"].to_numpy(np.int64), sizes["c"].to_numpy(np.int64)
        entries = float((c * (n * (100 - pct) / 100 + (2 if k is None else 4))).sum())
        self.bits = min(20, max(8, int(entries / PER_BUCKET).bit_length()))
        self.parts = self._parts(ranks, n, c)

    def _parts(self, ranks: np.ndarray, n: np.ndarray, c: np.ndarray) -> int:
        """Passes over the texts that pack a share of the keys each, so that what a pass shuffles is in proportion to the words.

        The more uses words have, the more keys of two words a bag has: the more texts, the more a text, up to the square of
        its prefix. Counts of all units by size tell how many keys there are.
        """
        if self.k is not None:  # a set of shingles has its prefix and no more
            return 1
        n, c = n[n >= max(1, self.least)], c[n >= max(1, self.least)]
        keys = float((c * mean_keys(n, self.pct, ranks, RARE)).sum())
        return max(1, int(np.ceil(keys / max(1.0, KEYS_A_WORD * float((c * n).sum())))))

    def _lists(self, parts: list[DataFrame], turn: int, wanted, bits: int) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b, m, w) and long lists (key, sid, n) of packed entries, of whose parts each is settled before the next is packed.

        Each round asks for longer and denser lists before it calls for a hub: that settles what is left sooner,
        and changes the cost only.
        """
        name, limits = f"found{turn}", (self.long_list << turn, self.dense, P.EACH << 2 * turn)
        read = P.read_lists(self.pct, wanted, bits, *limits, turn == 0, P.HEADS if turn else 0)
        dealt = [x.select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket") for x in parts]
        found = _union([self.scratch.table(x.mapInArrow(read, P.FOUND), f"{name}-{i}") for i, x in enumerate(dealt)])
        return found.where("key is null").select("a", "b", "m", "w"), found.where("key is not null").select("key", F.col("a").alias("sid"), "n").distinct()

    def rounds(self, hubs, places=None) -> None:
        scratch, pct = self.scratch, self.pct
        packed = [scan_keys(self.df, self.cut, self.k, pct, self.rarity, self.boundary, self.least, self.bits, self.long_list, (i, self.parts)) for i in range(self.parts)]
        pairs, long = self._lists(packed, 0, partial(shared_words, pct=pct) if self.k is None else shared, self.bits)
        counted = pairs.groupBy("a", "b").agg(F.sum("m").alias("m"), F.min("w").alias("w")).where("m >= w").select("a", "b")
        many, near, turn = [scratch.table(counted, "pairs0")], [], 0
        long = scratch.table(long, "long0")
        self.members = None
        while long.limit(1).count():
            if self.members is None:
                self._gather(many[0].select(F.explode(F.array("a", "b")).alias("sid")).unionByName(long.select("sid")), places)
                listed = scratch.table(self._of(scratch.table(long.select("sid").distinct(), "inlists")), "listed", random=True)
            star = scratch.table(hub_pairs(long, hubs(long), scratch, str(turn)), f"star{turn}")
            # few buckets for few entries: a pair that shares several keys of a bucket is given once
            bits = min(20, (star.count() // 1000).bit_length())
            step = scratch.table(self._both(star, listed).mapInArrow(differences(self.rarity, pct, bits, self.long_list << turn + 1), f"a long, b long, {P.BLOBS}"), f"step{turn}")
            near.append(step.where("bucket is null").select("a", "b"))
            turn += 1
            pairs, long = self._lists([step.where("bucket is not null")], turn, one, bits)
            many.append(pairs.select("a", "b"))
            long = scratch.table(long, f"long{turn}")
        if self.members is None:
            self._gather(many[0].select(F.explode(F.array("a", "b")).alias("sid")), places)
        self.pairs = many[0] if len(many) == 1 else scratch.table(_union(many).distinct(), "pairs")
        empty = self.pairs.where("false")
        self.near = scratch.table(_union(near).distinct(), "near") if near else empty
        self.rarity.unpersist()
        scratch.drop("listed", "inlists", *(f"{x}{i}" for x in ("long", "star", "step", "order", "hubs") for i in range(turn + 1)), *[x for x in scratch.names if x.startswith("found")])

    def _gather(self, sids: DataFrame, places) -> None:
        """Members of the sets of sids, by one more scan, which hashes their places only; the bitmap has 16 bits a set, up to 16 MB."""
        self.wanted = self.scratch.table(sids.distinct(), "wanted")
        bits = min(27, max(20, (16 * self.wanted.count()).bit_length()))
        if places is None:
            at = self.units.groupBy("sid").agg(F.min(F.struct("id", "h", "unit")).alias("first")).join(self.wanted, "sid", "left_semi")
        else:
            at = places()
        bitmap = self.spark.sparkContext.broadcast(build_bitmap(at.select("first.*"), bits))
        self.members = self.scratch.table(scan_members(self.df, self.cut, self.k, bitmap, bits, self.least), "members", random=True)
        bitmap.unpersist()

    def _of(self, sids: DataFrame) -> DataFrame:
        """The members of a written table of sets, and above FEW of them of few others, before any are shuffled."""
        n = sids.count()
        return self.members.join(F.broadcast(sids), "sid", "left_semi") if n <= FEW else marked(self.members, sids, min(27, max(20, (16 * n).bit_length())))

    def _both(self, pairs: DataFrame, m: DataFrame) -> DataFrame:
        """(a, b, ma, mb) of a written table of pairs; a set that is in many pairs is spread over tasks."""
        out = split_join(pairs.select("a", "b"), m.select(F.col("sid").alias("a"), F.col("members").alias("ma")), "a", F.col("b"))
        return split_join(out, m.select(F.col("sid").alias("b"), F.col("members").alias("mb")), "b", F.col("a"), counted=pairs).select("a", "b", "ma", "mb")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of a written table of distinct pairs (a, b), those at or above the threshold.

        Sets of shingles, which are large, and more than FEW pairs of bags are compared by BRIEF bits of a member first; whole members are shuffled of the sets in pairs left open.
        """
        m = self.members
        if self.k is not None or pairs.count() > FEW:
            brief = m.select("sid", F.transform("members", lambda x: F.shiftright(x, 64 - BRIEF).cast("short")).alias("members"))
            pairs = self.scratch.table(self._both(pairs, brief).mapInArrow(may_reach(self.pct), "a long, b long"), f"{name}-open")
            m = self._of(self.scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), f"{name}-left"))
        both = self._both(pairs, m).withColumn("o", F.size(F.array_intersect("ma", "mb"))).withColumn("u", F.size("ma") + F.size("mb") - F.col("o"))
        return self.scratch.table(both.where(F.lit(100) * F.col("o") >= F.lit(self.pct) * F.col("u")).select("a", "b"), name)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(sid, comp): comp is the least node reachable. Rounds of least-neighbour labels and pointer jumps.

    Labels are written each round; nothing but a count of changes and the few hot keys (split_join) reach the driver.
    """
    both = scratch.table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("u").alias("sid")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), f"{name}-0")
    i = 0
    while True:
        i += 1
        sent = split_join(both, labels.withColumnRenamed("sid", "u"), "u", F.col("v")).groupBy(F.col("v").alias("sid")).agg(F.min("comp").alias("got"))
        new = scratch.table(labels.join(sent, "sid", "left").select("sid", F.col("comp").alias("was"), F.least("comp", F.coalesce("got", "comp")).alias("via")), f"{name}-n{i}")
        # a label is itself a node: take its label
        jumped = split_join(new, labels.select(F.col("sid").alias("via"), F.col("comp").alias("further")), "via", F.col("sid"), "left")
        out = scratch.table(jumped.select("sid", "was", F.least("via", F.coalesce("further", "via")).alias("comp")), f"{name}-{i}")
        changed = out.where("was <> comp").limit(1).count()
        scratch.drop(f"{name}-{i - 1}", f"{name}-n{i}")
        labels = out.select("sid", "comp")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels

"""Word hashing and ordering in vectors, against sets of words."""

import random

import numpy as np

from quillrock.llm import shingles as S


def test_shingle_sets_equal_sets_of_word_tuples():
    rng = random.Random(3)
    bits = [b" ", b"\t", b"a", b"b", b"ab", b"\xc3\xa9", b" ", b"\x0b", b"\x1f"]
    seen: dict[int, dict] = {}
    for _ in range(300):
        units = [b"".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        k = rng.choice([1, 2, 3, 5])
        h, offsets = S.shingle_sets(units, k)
        for i, unit in enumerate(units):
            words = unit.split()
            want = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}
            got = h[offsets[i] : offsets[i + 1]].tolist()
            assert got == sorted(set(got)) and len(got) == len(want)
            assert seen.setdefault(k, {}).setdefault(frozenset(want), frozenset(got)) == frozenset(got)
    for sets in seen.values():
        assert len(set(sets.values())) == len(sets)


def test_words_of_blocks_and_very_long_words():
    word = b"x" * (2 * S._BLOCK + 5)
    h, n = S.word_hashes([b"a " + word, b"", b"a b " * (S._BLOCK // 2), word])
    assert n.tolist() == [2, 0, S._BLOCK, 1]
    assert h[1] == h[-1] and h[0] == h[2] and len(set(h.tolist())) == 3


def test_order_is_full_where_prefixes_tie():
    rng = np.random.default_rng(2)
    unit, count = np.sort(rng.integers(0, 9, 1000)), rng.integers(0, 4, 1000).astype(np.uint8)
    for h in (rng.integers(0, 2**63, 1000).astype(np.uint64), np.arange(1000, 0, -1).astype(np.uint64)):
        assert (S.ordered(unit, h, count) == np.lexsort((h, count, unit))).all()
        assert (h[S.ordered(unit, h)] == h[np.lexsort((h, unit))]).all()


def test_ids_of_many_short_units_differ():
    """Ids are 64 bits of all members, however few these are."""
    for make, k, n in ((lambda i: b"w%d" % (i * 7919), None, 200_000), (lambda i: b"a%d b%d" % (i * 31, i * 17), None, 400_000), (lambda i: b"note %d ends here" % i, 4, 200_000)):
        units = [make(i) for i in range(n)]
        if k is None:
            h, lens = S.word_hashes(units)
            offsets = np.concatenate(([0], np.cumsum(lens)))
        else:
            h, offsets = S.shingle_sets(units, k)
        ids = S.set_ids(h, offsets)
        assert len(np.unique(ids)) == n and not (ids == 0).any()
        # every eighth of the id's bits is used
        assert all(len(np.unique((ids.view(np.uint64) >> np.uint64(8 * i)) & np.uint64(255))) == 256 for i in range(8))


def test_ids_of_bags_ignore_order_and_count_repeats():
    h, lens = S.word_hashes([b"a b b", b"b a b", b"a b", b"a a b", b""])
    ids = S.set_ids(h, np.concatenate(([0], np.cumsum(lens)))).tolist()
    assert ids[0] == ids[1] and len(set(ids)) == 4 and ids[4] == 0


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for fold in (True, False):
        for _ in range(300):
            x = set(rng.integers(0, 2**40, int(rng.integers(1, 120))).tolist())
            y = set(list(x)[: int(rng.integers(0, len(x) + 1))]) | set(rng.integers(0, 2**40, int(rng.integers(1, 30))).tolist())
            sets = [np.array(sorted(s), np.uint64) for s in (x, y)]
            n = np.array([len(s) for s in sets])
            own, wide = S.parities(np.concatenate(sets), n, fold)
            assert S.apart(own[:1], own[1:], n[:1], n[1:], wide[:1], wide[1:], fold)[0] <= len(x ^ y)

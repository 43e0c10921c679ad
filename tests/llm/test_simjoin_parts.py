"""Keys packed in several passes, and pairs given once for all the differences that they share."""

import numpy as np
import pyarrow as pa

from quillrock.llm import line_dedup, postings, simjoin
from quillrock.llm.common import Scratch
from tests.llm.test_llm_operators import bag_gone, near_group


def test_keys_in_passes(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "RARE", 0)
    monkeypatch.setattr(simjoin, "KEYS_A_WORD", 0.08)
    seen = []
    lists = simjoin.Joined._lists
    monkeypatch.setattr(simjoin.Joined, "_lists", lambda self, parts, *more: (seen.append(len(parts)), lists(self, parts, *more))[1])
    df = spark.createDataFrame(near_group(120, 40, 8, 3), "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df, out="clean").collect()
    assert {(r.doc_id, r.text): r.removed_lines for r in got if r.removed_lines} == bag_gone(df.collect())
    assert seen[0] > 2


def test_common_words_make_more_keys():
    n = np.array([10, 50, 100])
    rare, common = np.zeros(1000, np.int64) + 3, np.zeros(1000, np.int64) + 200
    assert simjoin.mean_keys(n, 80, rare, 64).tolist() == [3, 11, 21]
    assert simjoin.mean_keys(n, 80, common, 64).tolist() == [6, 66, 231]


def test_keys_of_bags_that_mix_rare_and_common_words():
    """The mean is that of the keys which such bags get, not of a bag with the mean number of rare words."""
    rng = np.random.default_rng(3)
    common = float(simjoin.S.count_of(np.array([200]))[0])
    ranks = np.concatenate((np.full(int(common / 12), 3), [200]))  # a fifth of the uses are of rare words
    for size in (10, 50, 100, 130):
        counts = np.sort(np.where(rng.random((2000, size)) < 0.2, 3, 200), axis=1).reshape(-1)
        place, n = np.tile(np.arange(size), 2000), np.full(2000 * size, size)
        keys, _ = simjoin.word_keys(rng.integers(1, 2**63, 2000 * size).astype(np.uint64), counts, place, n, 80, 64)
        (mean,) = simjoin.mean_keys(np.array([size]), 80, ranks, 64)
        assert abs(mean - len(keys) / 2000) < 0.1 * mean


def test_many_pairs_of_bags_are_compared_by_first_bits(spark, monkeypatch):
    """Beyond FEW whole members are shuffled only of the sets in pairs left open; scanned units go before keys are packed."""
    monkeypatch.setattr(simjoin, "FEW", 0)
    written, there = [], []
    table, lists = Scratch.table, simjoin.Joined._lists
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, *a, **k: (written.append(name), table(self, df, name, *a, **k))[1])
    monkeypatch.setattr(simjoin.Joined, "_lists", lambda self, *a: (there.append("units" in self.scratch.names), lists(self, *a))[1])
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 20 : i % 20 + 30] + [f"x{i}", f"x{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df, out="clean").collect()
    assert {(r.doc_id, r.text): r.removed_lines for r in got if r.removed_lines} == bag_gone(df.collect())
    assert {"sure-open", "sure-left"} <= set(written) and not any(there)


def test_members_by_bitmap(spark):
    members = spark.createDataFrame([(i * 7919 - 2**40, [i, -i]) for i in range(3000)], "sid long, members array<long>")
    asked = members.where("members[0] % 10 = 0").select("sid")
    found = simjoin.marked(members, asked, 20)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.sid: list(r.members) for r in found.collect()}
    assert {r.sid for r in asked.collect()} <= set(got) and len(got) < 320
    assert all(v == [(s + 2**40) // 7919, -(s + 2**40) // 7919] for s, v in got.items())


def test_first_bits_of_members_in_any_order():
    brief = [[5, 3, 5, 9, -1], [9, 5, -1, 3, 5]]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), *(pa.array([x], pa.list_(pa.int16())) for x in brief)], ["a", "b", "ma", "mb"])
    assert [x for r in simjoin.may_reach(100)([batch]) for x in r.column(0).to_pylist()] == [1]


def test_pair_once_for_shared_differences():
    """Two sets share three keys in lists of different buckets: the first of them gives the pair."""
    keys = (np.arange(1, 4, dtype=np.uint64) << np.uint64(62)).astype(np.uint64)
    heads = np.where(np.arange(postings.HEADS) < np.arange(3)[:, None], np.resize(keys, postings.HEADS), 0)
    packer = postings.Packer(2, 512)
    for sid in (5, 6):
        assert not list(packer.add(keys, np.full(3, sid), np.zeros(3), np.zeros(3), np.full(3, 20), np.full(3, 4), np.arange(3), np.zeros(3), heads))
    batches = [b.select(["bucket", "blob"]) for b in packer.end()]
    found = list(postings.read_lists(80, simjoin.one, 2, 512, 16, 8, False, postings.HEADS)(batches))
    assert [(x["a"], x["b"]) for b in found for x in b.to_pylist()] == [(5, 6)]


def test_toxicity_scores_many_texts_at_a_time():
    """A text's logit is the one it has alone, in any company; a word's code is that of its bare lower-case form, ASCII or not."""
    import xxhash

    from quillrock.llm import toxicity as T

    for word in ("Ab,", "(ÄBCDE)", "x...", "!!!", "İstanbul'", "Straße", "y" * 60, "|δΣ|"):
        w = word.strip(T._TRIM.decode()).lower()
        own, stem = (1 + xxhash.xxh3_64_intdigest(x.encode(), i) % T.MASK for i, x in enumerate((w, w[: T.STEM])))
        assert T.buckets(f" {word}\t{word}").tolist() == [own | stem << T.BITS if w else 0] * 2
    rng = np.random.default_rng(5)
    model = T.Cnn(np.arange(1, 60))
    model.b = [rng.normal(0, 0.3, T.FILTERS).astype(np.float32) for _ in T.WIDTHS]
    words = [rng.integers(0, most, n) | rng.integers(0, most, n) << T.BITS for n in (0, 1, 2, 3, 40, 300) for most in (1, 70, 900)]
    scorer = T.Scorer(model)
    many = scorer(words)
    assert np.allclose(many, [model.logit(w) for w in words], atol=1e-4)
    assert (many[::-1] == scorer(words[::-1])).all() and all(scorer([w])[0] == z for w, z in zip(words, many, strict=True))


def test_pairs_of_sets_are_told_apart_by_first_bits():
    """Whole members are read of few pairs that are not similar, and no similar pair is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = []
    for i in range(2300):
        n, same = int(rng.integers(1, 300)), rng.random()
        a = rng.integers(0, 1 << 64, n, np.uint64)
        b = np.concatenate((a[: int(n * same)], rng.integers(0, 1 << 64, n - int(n * same), np.uint64)))
        if i % 7 == 0:  # members of equal first bits
            a, b = a >> np.uint64(3), b >> np.uint64(3) | np.uint64(i % 2 << 40)
        a, b = np.unique(a), np.unique(b)
        o = len(np.intersect1d(a, b))
        rows.append((i, -i, *((x >> np.uint64(64 - simjoin.BRIEF)).astype(np.uint16).view(np.int16) for x in (a, b)), 100 * o >= 85 * (len(a) + len(b) - o)))
    a, b, ma, mb, similar = zip(*rows, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ma, pa.list_(pa.int16())), pa.array(mb, pa.list_(pa.int16()))], ["a", "b", "ma", "mb"])
    got = {x for r in simjoin.may_reach(85)([batch]) for x in r.column(0).to_pylist()}
    want = {i for i, s in zip(a, similar, strict=True) if s}
    assert want <= got and 100 < len(want) and len(got) < 1.1 * len(want) + 20

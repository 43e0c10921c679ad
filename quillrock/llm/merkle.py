"""Merkle dataset manifest over an external-memory node store.

Leaves are hashed in one scan with built-in functions and range-sorted by (tree, key, leaf); a hot tree is cut into
many ranges. Each sorted run is streamed into the first level of the store, Parquet tables of nodes in order, one
table a level; a node's coordinate is (tree, position). Every next level is made by a sequential read of the
last: a task hashes each run of FAN consecutive nodes that it has seen whole. Runs cut by the ends of a task's
stretch (a few a task) are put together by a small aggregation. So no level is shuffled but for those pieces.

The subroots of all trees are leaves of one more tree, ordered by tree. Proofs come from the top down: the runs
of a level are merge-joined with the paths of their parents by coordinate, and each child's path is its siblings
followed by its parent's path. Paths are kept as bytes for the inner nodes; for leaves only their digests leave the task.

Odd cases: a null tree key is a tree of its own, before all; null columns are hashed as `-`; null keys come first;
rows that tie in the key come by leaf, and equal rows in the order they were read, which changes no digest of theirs
but for their places; a document that repeats is a leaf each time; texts of any length are hashed whole; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import Scratch

FAN = 16
#: Rows of an Arrow batch that a task gives out.
GIVE = 512
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Consecutive idx of a part: neighbours in their level, with nothing between. part -1: put together, without a place.
PLACE = [("part", pa.int32()), ("idx", pa.int64())]
RUN = [*PLACE, ("tree", pa.string()), ("parent", pa.int64()), ("at", pa.list_(pa.int32())), ("hashes", pa.list_(pa.binary())), ("ids", pa.list_(pa.string())), ("others", pa.list_(pa.binary())), ("whole", pa.bool_())]
RUN_TYPES = "part int, idx long, tree string, parent long, at array<int>, hashes array<binary>, ids array<string>, others array<binary>, whole boolean"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def tree_of(key: Column) -> Column:
    """A tree's name: orders as the key does, bytewise, null before all."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def node_hash(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def _give(rows: list[list], schema: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True)], [name for name, _ in schema])


def _ranked(batches):
    """Sorted rows (tree, id, hash, other) with their rank in their tree as far as this task sees it."""
    part, idx, tree, rank = TaskContext.get().partitionId(), 0, None, 0
    for b in batches:
        ranks = []
        for t in b.column(0).to_pylist():
            rank = rank + 1 if t == tree else 0
            tree = t
            ranks.append(rank)
        place = [pa.array([part] * len(b), pa.int32()), pa.array(range(idx, idx + len(b)), pa.int64()), pa.array(ranks, pa.int64())]
        idx += len(b)
        yield pa.RecordBatch.from_arrays([*place, *b.columns], ["part", "idx", "pos", "tree", "id", "hash", "other"])


def leaf_level(leaves: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(part, idx, tree, pos, hash, id, other) of leaves (tree, key, row, id, hash, other), sorted by tree, key, hash and row.

    A tree that goes on in a later part is the last of its part and the first of the later one, so one offset a part,
    for its first tree, turns ranks into positions.
    """
    order = ["tree", F.col("key").asc_nulls_first(), "hash", "row"]
    sorted_leaves = leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "id", "hash", "other")
    ranked = scratch.table(sorted_leaves.mapInArrow(_ranked, "part int, idx long, pos long, tree string, id string, hash binary, other binary"), f"{name}-ranked")
    ends = ranked.groupBy("part").agg(F.min_by("tree", "idx").alias("first"), F.max_by("tree", "idx").alias("last"), F.max_by("pos", "idx").alias("pos"))
    asks = ends.select("part", F.col("first").alias("tree"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks"))
    gives = ends.select("part", F.col("last").alias("tree"), F.col("pos") + 1, F.lit(False))
    earlier = Window.partitionBy("tree").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    offsets = asks.union(gives).withColumn("offset", F.sum("n").over(earlier)).where("asks and offset > 0").select("part", F.col("tree").alias("of"), "offset")
    # at most one row a part
    moved = ranked.join(F.broadcast(scratch.table(offsets, f"{name}-offsets")), "part", "left")
    pos = F.col("pos") + F.when(F.col("tree") == F.col("of"), F.col("offset")).otherwise(F.lit(0))
    return moved.select("part", "idx", "tree", pos.alias("pos"), "hash", "id", "other")


class Runs:
    """Cuts a stretch of nodes into runs; a run is whole if all its children were seen here.

    Its last child is known as such if it is the sixteenth, or if a neighbour of another tree follows.
    """

    def __init__(self):
        self.part, self.idx, self.run, self.last, self.rows = TaskContext.get().partitionId(), 0, None, None, []

    def add(self, part, idx, tree, pos, digest, ident, other):
        near = self.last is not None and part >= 0 and self.last == (part, idx - 1)
        parent, at = divmod(pos, FAN)
        if self.run is not None and not (near and self.run[0] == tree and self.run[1] == parent):
            self._close(near and self.run[0] != tree)
        self.idx += not near  # what this task hasn't seen may stand here
        if self.run is None:
            self.run = (tree, parent, [], [], [], [])
        for values, v in zip(self.run[2:], (at, digest, ident, other), strict=True):
            values.append(v)
        self.last = (part, idx)

    def _close(self, ended: bool):
        tree, parent, at, hashes, ids, others = self.run
        whole = at[0] == 0 and (len(at) == FAN or ended)
        # a lone node is its tree's top and leaves no gap in the next level; a run that is put together elsewhere does
        self.idx += not (whole and parent == 0 and len(at) == 1)
        self.rows.append([self.part if whole else -1, self.idx, tree, parent, at, hashes, ids, others, whole])
        self.run = None

    def given(self, least: int):
        if len(self.rows) >= least:
            yield _give(self.rows, RUN)
            self.rows = []

    def end(self):
        if self.run is not None:
            self._close(False)
        yield from self.given(1)


def _leaf_runs(batches):
    """Runs of rows (part, idx, tree, pos, hash, id, other)."""
    runs = Runs()
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            runs.add(*row)
            yield from runs.given(GIVE)
    yield from runs.end()


def _upper_runs(batches):
    """Runs of the next level, whose nodes are the hashes of rows (part, idx, tree, parent, hashes)."""
    runs = Runs()
    for b in batches:
        for part, idx, tree, parent, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            runs.add(part, idx, tree, parent, node_hash(hashes), None, None)
            yield from runs.given(GIVE)
    yield from runs.end()


def store_level(runs: DataFrame, scratch: Scratch, name: str, level: int) -> DataFrame:
    """A level's runs, whole: (part, idx, tree, parent, at, hashes, ids, others, top)."""
    cut = scratch.table(runs, f"{name}-cut{level}")
    pieces = cut.where("not whole").groupBy("tree", "parent").agg(F.sort_array(F.collect_list(F.struct("at", "hashes", "ids", "others"))).alias("p"))
    joined = [F.flatten(F.col(f"p.{c}")).alias(c) for c in ("at", "hashes", "ids", "others")]
    mended = pieces.select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("idx"), "tree", "parent", *joined)
    done = scratch.table(cut.where("whole").drop("whole").unionByName(mended).withColumn("top", F.expr("parent = 0 and size(at) = 1")), f"{name}/level={level}")
    scratch.drop(f"{name}-cut{level}")
    return done


def build(leaves: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels of all trees, from the leaves' runs to those of the last lone nodes."""
    levels = [store_level(leaf_level(leaves, scratch, name).mapInArrow(_leaf_runs, RUN_TYPES), scratch, name, 0)]
    scratch.drop(f"{name}-ranked", f"{name}-offsets")
    while levels[-1].where("not top").limit(1).count():
        below = levels[-1].where("not top").select("part", "idx", "tree", "parent", "hashes")
        levels.append(store_level(below.mapInArrow(_upper_runs, RUN_TYPES), scratch, name, len(levels)))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of every tree."""
    found = [x.where("top").select("tree", F.col("hashes")[0].alias("hash")) for x in levels]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def entry(hashes: list[bytes], i: int) -> bytes:
    """A step of a path: the node's place, the number of its siblings, the siblings."""
    return bytes((i, len(hashes) - 1)) + b"".join(hashes[:i] + hashes[i + 1 :])


def steps(path: bytes):
    """(place, siblings) from the leaf's run upward."""
    at = 0
    while at < len(path):
        i, n = path[at], path[at + 1]
        yield i, [path[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]
        at += 2 + 32 * n


def fold(digest: bytes, path: bytes) -> bytes:
    for i, siblings in steps(path):
        digest = node_hash([*siblings[:i], digest, *siblings[i:]])
    return digest


def proof_text(path: bytes) -> str:
    return "".join([s.hex() for _, siblings in steps(path) for s in siblings])


PATH = "tree string, pos long, path binary, top_hash binary"


def _paths(batches):
    """Paths of the children of rows (tree, parent, hashes, top, path, top_hash)."""
    for b in batches:
        rows = []
        for tree, parent, hashes, top, path, top_hash in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows += [[tree, parent * FAN + i, path if top else entry(hashes, i) + path, top_hash] for i in range(len(hashes))]
        if rows:
            yield _give(rows, [("tree", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("top_hash", pa.binary())])


def with_paths(levels: list[DataFrame], base: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The lowest runs with `path` and `top_hash`: what leads from their parent to the last root.

    base: (tree, path, top_hash) of each tree's top. Each level is merge-joined with its parents by coordinate.
    """
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        runs = levels[k].select("tree", "parent", "at", "hashes", "ids", "others", "top")
        out = runs.where("top").join(base.hint("merge"), "tree")
        if paths is not None:
            parents = paths.withColumnRenamed("pos", "parent").hint("merge")
            out = out.unionByName(runs.where("not top").join(parents, ["tree", "parent"]))
        if k == 0:
            return out
        paths = scratch.table(out.select("tree", "parent", "hashes", "top", "path", "top_hash").mapInArrow(_paths, PATH), f"{name}-paths{k}")
    raise AssertionError("no levels")


def _tree_paths(batches):
    """(tree, path, top_hash) of the leaves of the tree of trees: their ids are trees, their hashes these trees' tops."""
    for b in batches:
        rows = []
        for hashes, ids, top, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows += [[ids[i], path if top else entry(hashes, i) + path, hashes[i]] for i in range(len(hashes))]
        if rows:
            yield _give(rows, [("tree", pa.string()), ("path", pa.binary()), ("top_hash", pa.binary())])


def _proofs(batches):
    """Leaves' digests from rows (hashes, ids, others, top, path, top_hash)."""
    for b in batches:
        rows = []
        for hashes, ids, others, top, path, top_hash in zip(*(c.to_pylist() for c in b.columns), strict=True):
            above, folded = proof_text(path), {}
            listed = [h.hex() for h in hashes]
            for i, (h, other) in enumerate(zip(hashes, others, strict=True)):
                mine = h if other is None else other
                node = mine if top else node_hash([*hashes[:i], mine, *hashes[i + 1 :]])
                if node not in folded:
                    folded[node] = fold(node, path).hex()
                siblings = "" if top else "".join(listed[:i] + listed[i + 1 :])
                rows.append([ids[i], listed[i], top_hash.hex(), hashlib.sha256((siblings + above).encode()).hexdigest(), folded[node]])
        if rows:
            yield _give(rows, [(c, pa.string()) for c in ("id", "leaf", "subroot", "proof_sha256", "folded_root")])


def manifest(docs: DataFrame, columns=COLUMNS, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    columns: what a leaf hashes, in order: the id, the tree's key, and others, the text last. tampered: the text as a
    verifier finds it; its leaf is folded along the original siblings.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    ident, key = F.col(columns[0]).cast("long"), F.col(columns[1]).cast("string")
    own = leaf_of(*map(F.col, columns))
    other = own if tampered is None else leaf_of(*map(F.col, columns[:-1]), tampered)
    leaves = docs.select(tree_of(key).alias("tree"), ident.alias("key"), F.monotonically_increasing_id().alias("row"), ident.cast("string").alias("id"), own.alias("hash"), other.alias("other"))
    leaves = scratch.table(leaves.withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other"))), "leaves")
    levels = build(leaves, scratch, "trees")
    scratch.drop("leaves")
    forest = tops(levels).select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.lit(0).cast("long").alias("row"), F.col("tree").alias("id"), "hash", F.lit(None).cast("binary").alias("other"))
    last = build(forest, scratch, "forest")
    found = tops(last).collect()  # one row, or none of an empty table
    root = bytes(found[0]["hash"]) if found else b""
    start = docs.sparkSession.createDataFrame([("", b"", root)], "tree string, path binary, top_hash binary")
    base = with_paths(last, start, scratch, "forest").select("hashes", "ids", "top", "path").mapInArrow(_tree_paths, "tree string, path binary, top_hash binary")
    base = scratch.table(base, "base")
    below = with_paths(levels, base, scratch, "trees").select("hashes", "ids", "others", "top", "path", "top_hash")
    out = below.mapInArrow(_proofs, "id string, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root.hex()).alias("verified"))


def lowered(ident: Column, text: Column) -> Column:
    """The corpus query's tampering: A-Z of the texts of a fifth of the ids, told by crc32, in lower case."""
    hit = F.pmod(F.crc32(ident.cast("long").cast("string").cast("binary")), F.lit(5)) == 0
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def oracle(depth: int = 6) -> str:
    """The corpus query in SQL, level by level; `depth` levels of FAN are enough for FAN ** depth leaves in a tree."""
    coded = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(coded, ("doc_id", "source", "lang", "n_chars"))) + f" || {text})"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1)))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    out = [
        f"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
h AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf(coded('text'))} AS leaf, CASE WHEN s IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(coded('low'))} ELSE {leaf(coded('text'))} END AS mine FROM d, t),
n0 AS (SELECT doc_id, g, leaf, mine, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
a0 AS (SELECT g, pos, leaf AS hash FROM n0)"""
    ]

    def levels(first: str, name: str) -> None:
        """Of nodes `first`0 (g, pos, hash): tables of each level with what stands left and right of a node in its run."""
        for k in range(depth):
            run = f"PARTITION BY g, pos // {FAN} ORDER BY pos ROWS BETWEEN"
            out.append(f"""{name}{k} AS (SELECT g, pos, hash, count(*) OVER (PARTITION BY g) > 1 AS open, coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {first}{k}),
{first}{k + 1} AS (SELECT g, pos // {FAN} AS pos, CASE WHEN bool_or(open) THEN sha256(string_agg(hash, '' ORDER BY pos)) ELSE any_value(hash) END AS hash FROM {name}{k} GROUP BY g, pos // {FAN})""")

    def climbed(rows: str, name: str, key: str, place: str, made: str) -> None:
        """rows with `folded` and `proof` taken up through all levels."""
        for k in range(depth):
            out.append(f"""{made}{k} AS (SELECT x.* EXCLUDE (folded, proof), CASE WHEN open THEN sha256(l || folded || r) ELSE folded END AS folded, CASE WHEN open THEN proof || l || r ELSE proof END AS proof
FROM {rows if k == 0 else f'{made}{k - 1}'} x JOIN {name}{k} y ON x.{key} = y.g AND x.{place} // {FAN**k} = y.pos)""")

    levels("a", "u")
    out.append("w0 AS (SELECT doc_id, g, leaf, pos, mine AS folded, '' AS proof FROM n0)")
    climbed("w0", "u", "g", "pos", "p")
    out.append(f"f AS (SELECT g AS tree, hash, row_number() OVER (ORDER BY g) - 1 AS place FROM a{depth}), b0 AS (SELECT 'all' AS g, place AS pos, hash FROM f)")
    levels("b", "v")
    out.append(f"w1 AS (SELECT p.*, f.hash AS subroot, f.place, 'all' AS forest FROM p{depth - 1} p JOIN f ON p.g = f.tree)")
    climbed("w1", "v", "forest", "place", "q")
    last = f"SELECT doc_id, leaf, subroot, b.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.hash AS verified FROM q{depth - 1}, b{depth} b"
    return ",\n".join(out) + "\n" + last


ORACLE = oracle()

"""Merkle manifest of a table, and inclusion proofs by octopus multiproofs.

Every group of rows is a binary tree over its rows in order; the groups' roots are the leaves of one
more tree, whose root stands for the table. A node is the digest of its children's hex digests, one
after the other; a node without a neighbour is the digest of itself alone.

Trees grow in blocks of ``2 ** BLOCK_BITS`` nodes: a task turns a block into all nodes above it up to
the block's root, and the block roots are the next round's nodes, so a tree of any size takes a few
rounds and no task holds more than a block. Proofs go the other way. A leaf partition (the wanted
leaves of one block) computes the smallest set of node coordinates that it cannot derive from its own
leaves, fetches these once, derives the nodes inside that its leaves share, and expands each leaf's
proof by itself. The way from a block's root on is the proof of that root, made by the same steps over
the roots; so no node near the top is fetched by all partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.session import materialize

BLOCK_BITS = 9
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<side:int,hash:string>>"
LEFT, NONE, RIGHT = -1, 0, 1


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: Iterable[Column]) -> Column:
    """Digest of the values: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    framed = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*framed), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""

    def step(node: Column, sibling: Column) -> Column:
        side, other = sibling["side"], sibling["hash"]
        pair = F.when(side == LEFT, F.concat(other, node)).when(side == RIGHT, F.concat(node, other)).otherwise(node)
        return F.sha2(pair, 256)

    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """The proof's digests from leaf to root, as one text."""
    return F.array_join(F.transform(F.filter(path, lambda s: s["side"] != NONE), lambda s: s["hash"]), "")


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Add ``idx`` (place in the tree, from 0) and ``n`` (nodes of the tree). ``rows`` is a written table.

    Rows are dealt out by range, so neither a large tree nor many equal rows meet in one task; the
    number of rows before each part comes from one row per tree and part.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "tie")
    placed = materialize(
        spread.sortWithinPartitions(tree, *order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()), "ordered-leaves"
    )
    part = F.shiftright("at", 33).alias("part")
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy(tree, part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    spans = spans.select(
        tree, "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy(tree)).alias("n"),
    )
    joined = placed.withColumn("part", F.shiftright("at", 33)).join(spans, [tree, "part"])
    return joined.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "first", "before", "part")


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(n - 1, 0).bit_length()


def parents(known: dict[int, str], n: int) -> dict[int, str]:
    """Digests of the next level from those of a whole run of a level with n nodes."""
    return {i // 2: digest(known[i], known[i + 1]) if i + 1 < n else digest(known[i]) for i in known if i % 2 == 0}


def missing(wanted: Iterable[int], n: int, levels: int) -> list[tuple[int, int]]:
    """Coordinates (level, place) of the fewest nodes that lead the wanted leaves ``levels`` up.

    A neighbour is missing unless it is wanted or derived itself; neighbours that do not exist are not.
    """
    out, here = [], set(wanted)
    for level in range(levels):
        out += [(level, i ^ 1) for i in sorted(here) if i ^ 1 not in here and i ^ 1 < n]
        here = {i // 2 for i in here}
        n = (n + 1) // 2
    return out


def expanded(wanted: dict[int, str], fetched: dict[tuple[int, int], str], n: int, levels: int) -> list[list[tuple[int, str]]]:
    """The proof of every wanted leaf, ``levels`` up: (side, digest) of its neighbour at each level."""
    paths: list[list[tuple[int, str]]] = [[] for _ in wanted]
    here, places = dict(wanted), list(wanted)
    for level in range(levels):
        full = here | {i ^ 1: fetched[level, i ^ 1] for i in here if i ^ 1 not in here and i ^ 1 < n}
        for path, i in zip(paths, places):
            path.append((NONE, "") if i ^ 1 >= n else (RIGHT if i % 2 == 0 else LEFT, full[i ^ 1]))
        here = parents(full, n)
        places = [i // 2 for i in places]
        n = (n + 1) // 2
    return paths


@dataclass
class Forest:
    """Trees side by side. ``base`` holds ``tree, n, idx, hash`` and what belongs to a leaf; round r of
    ``rounds`` holds ``tree, n, block, level, idx, hash`` of the nodes above, counted from its base."""

    base: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame  # tree, n, hash
    bits: int

    def level(self, r: int) -> DataFrame:
        """``tree, n, idx, hash`` of the nodes that round r starts from."""
        if r == 0:
            return self.base.select("tree", "n", "idx", "hash")
        above = self.rounds[r - 1].where(F.col("level") == self.bits)
        return above.select("tree", _next_n(F.col("n"), self.bits).alias("n"), "idx", "hash")


def _next_n(n: Column, bits: int) -> Column:
    return F.shiftright(n + ((1 << bits) - 1), bits)


def grown(base: DataFrame, bits: int) -> Forest:
    """All nodes over ``base`` (a written table with ``tree, n, idx, hash``)."""

    def above(table: pa.Table) -> pa.Table:
        tree, n, block = (table.column(c)[0].as_py() for c in ("tree", "n", "block"))
        here = dict(zip(table.column("idx").to_pylist(), table.column("hash").to_pylist()))
        rows, left = [], n
        for level in range(1, min(bits, height(n)) + 1):
            here = parents(here, left)
            left = (left + 1) // 2
            rows += [(level, i, h) for i, h in here.items()]
        levels, idx, hashes = zip(*rows) if rows else ((), (), ())
        return pa.table({
            "tree": pa.array([tree] * len(rows), pa.string()), "n": pa.array([n] * len(rows), pa.int64()),
            "block": pa.array([block] * len(rows), pa.int64()), "level": pa.array(levels, pa.int32()),
            "idx": pa.array(idx, pa.int64()), "hash": pa.array(hashes, pa.string()),
        })

    forest = Forest(base, [], base.sparkSession.createDataFrame([], "tree string, n bigint, hash string"), bits)
    sizes = base.groupBy("tree").agg(F.first("n").alias("n"))
    most = sizes.agg(F.max("n")).head()[0] or 0
    tops = [base.where(F.col("n") == 1).select("tree", "hash")]
    while most > 1:
        here = forest.level(len(forest.rounds)).where(F.col("n") > 1).withColumn("block", F.shiftright("idx", bits))
        rows = here.groupBy("tree", "block").applyInArrow(above, "tree string, n bigint, block bigint, level int, idx bigint, hash string")
        forest.rounds.append(materialize(rows, "merkle-nodes"))
        last = F.expr("n <= shiftleft(1L, level)")
        tops.append(forest.rounds[-1].where((F.col("n") <= 1 << bits) & last).select("tree", "hash"))
        most = (most + (1 << bits) - 1) >> bits
    forest.roots = materialize(reduce(DataFrame.unionByName, tops).join(sizes, "tree"), "merkle-roots")
    return forest


def proofs(forest: Forest, wanted: DataFrame, top: DataFrame | None = None, r: int = 0) -> DataFrame:
    """``wanted`` (nodes of round r's base: ``tree, n, idx, hash`` and more) with their ``path``.

    ``top``: ``tree, path`` from a tree's root on; without it paths end at the root.
    """
    bits = forest.bits
    keyed = wanted.withColumn("block", F.shiftright("idx", bits))
    ends = wanted.schema
    coordinates = "tree string, block bigint, level int, idx bigint"

    def lacking(table: pa.Table) -> pa.Table:
        tree, n, block = (table.column(c)[0].as_py() for c in ("tree", "n", "block"))
        gone = missing(table.column("idx").to_pylist(), n, min(bits, height(n)))
        return pa.table({
            "tree": pa.array([tree] * len(gone), pa.string()), "block": pa.array([block] * len(gone), pa.int64()),
            "level": pa.array([x[0] for x in gone], pa.int32()), "idx": pa.array([x[1] for x in gone], pa.int64()),
        })

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        paths: list[list[tuple[int, str]]] = []
        if len(left):
            n = left.column("n")[0].as_py()
            levels = min(bits, height(n))
            rows = list(zip(*(right.column(c).to_pylist() for c in ("level", "idx", "side", "hash"))))
            inside = {(level, idx): h for level, idx, side, h in rows if side is None}
            beyond = [(side, h) for _, _, side, h in sorted((x for x in rows if x[2] is not None), key=lambda x: x[0])]
            places = left.column("idx").to_pylist()
            found = dict(zip(places, expanded(dict(zip(places, left.column("hash").to_pylist())), inside, n, levels)))
            paths = [found[i] + beyond for i in places]
        flat = [s for path in paths for s in path]
        offsets = [0]
        for path in paths:
            offsets.append(offsets[-1] + len(path))
        steps = pa.StructArray.from_arrays(
            [pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.string())], ["side", "hash"]
        )
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
        return left.select([f.name for f in ends.fields]).append_column("path", lists)

    gone = keyed.select("tree", "n", "block", "idx").groupBy("tree", "block").applyInArrow(lacking, coordinates)
    nodes = forest.level(r).select("tree", F.lit(0).alias("level"), "idx", "hash")
    if r < len(forest.rounds):
        nodes = nodes.unionByName(forest.rounds[r].select("tree", "level", "idx", "hash"))
    fetched = gone.join(nodes, ["tree", "level", "idx"]).withColumn("side", F.lit(None).cast("int"))
    ended = keyed.where(F.col("n") <= 1 << bits).select("tree", "block").distinct()
    beyond = []
    if top is not None:
        beyond.append(ended.join(top, "tree"))
    if r + 1 < len(forest.rounds):
        roots = keyed.where(F.col("n") > 1 << bits).select("tree", F.col("block").alias("idx")).distinct()
        above = proofs(forest, forest.level(r + 1).join(roots, ["tree", "idx"]).select("tree", "n", "idx", "hash"), top, r + 1)
        beyond.append(above.select("tree", F.col("idx").alias("block"), "path"))
    sent = fetched.select("tree", "block", "level", "idx", "side", "hash")
    for paths in beyond:
        steps = paths.select("tree", "block", F.posexplode("path").alias("place", "s"))
        sent = sent.unionByName(steps.select(
            "tree", "block", (F.col("place") + bits).cast("int").alias("level"), F.lit(None).cast("bigint").alias("idx"), "s.side", "s.hash"
        ))
    pairs = keyed.groupBy("tree", "block").cogroup(sent.groupBy("tree", "block"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ends.fields)
    return pairs.applyInArrow(expand, f"{kinds}, path {PATH}")


@dataclass
class Manifest:
    """``leaves``: the trees of the groups; ``groups``: the tree over their roots."""

    leaves: Forest
    groups: Forest

    def rows(self) -> DataFrame:
        """``tree, n, subroot, root``: one row per group. ``tree`` is ``=`` and the group's value, or empty for null."""
        root = self.groups.roots.head()
        return self.leaves.roots.select(
            "tree", "n", F.col("hash").alias("subroot"), F.lit(root["hash"] if root else None).cast("string").alias("root")
        )

    def prove(self, ids: DataFrame | None = None) -> DataFrame:
        """``key, tree, n, idx, hash, changed, subroot, root, path`` of the leaves whose key is in ``ids``
        (a column ``key``), or of all."""
        wanted = self.leaves.base
        if ids is not None:
            wanted = wanted.join(ids.select("key").distinct(), "key", "left_semi")
        top = materialize(proofs(self.groups, self.groups.base).select(F.col("of").alias("tree"), "path"), "root-proofs")
        found = proofs(self.leaves, wanted, top)
        return found.join(self.rows().drop("n"), "tree")


def manifest(
    docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = LEAF_COLUMNS,
    changed: Column | None = None, bits: int = BLOCK_BITS,
) -> Manifest:
    """The Merkle manifest of ``docs``: a tree per value of ``group_col`` in the order of ``id_col``.

    A leaf is the digest of ``columns``. Ids ascend with null first; rows of one id ascend by their
    digest, and rows that agree in both are interchangeable. Groups ascend bytewise, null first. Each
    repeated row is a leaf of its own. An empty table has no group and no root. Extra columns are
    ignored; null and empty values have different digests. ``changed`` is a second digest kept beside
    each leaf (by default the leaf), to be checked against the proof.
    """
    group = F.col(f"`{group_col}`").cast("string")
    hashed = docs.select(
        F.col(f"`{id_col}`").alias("key"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        leaf(F.col(f"`{c}`") for c in columns).alias("hash"), *([] if changed is None else [changed.alias("changed")]),
    )
    if changed is None:
        hashed = hashed.withColumn("changed", F.col("hash"))
    leaves = grown(materialize(numbered(materialize(hashed, "leaves"), "tree", ["key", "hash"]), "merkle-leaves"), bits)
    roots = leaves.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    groups = grown(materialize(numbered(roots, "tree", ["of"]), "merkle-groups"), bits)
    return Manifest(leaves, groups)

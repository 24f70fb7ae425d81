"""Vector codes: one byte per part of a vector, by codebooks that are learned from all vectors.

Components become whole numbers, so every sum is exact and the codebooks are the same for any
partitioning. Of each part position only the distinct parts with their counts are learned from. They
lie in lexicographic order, which is the depth-first order of a trie with one level per dimension: a
part takes the squared distances to all entries that its predecessors have summed up along the
common prefix, and goes on from the first dimension that differs. Leaves take the nearest entry and
add their part to it, weighted by the count. A task works through its rows in blocks, one trie level
of a block after the other, and carries the last path on to the next block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.session import materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 1 << 14


class Path:
    """The way from the root of the trie to the last leaf, with the distances summed up along it."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.last: np.ndarray | None = None
        self.sums = np.zeros((book.shape[1], len(book)), dtype=np.int64)

    def distances(self, parts: np.ndarray) -> np.ndarray:
        """Squared distances (parts x entries) of the next leaves. Any order is right; sorted parts
        share most."""
        n, width = parts.shape
        differs = np.empty((n, width), dtype=bool)
        differs[1:] = parts[1:] != parts[:-1]
        differs[0] = True if self.last is None else parts[0] != self.last
        depth = np.where(differs.any(axis=1), differs.argmax(axis=1), width)  # where a leaf leaves the path before it
        sums, node = np.zeros((1, len(self.book)), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for d in range(width):
            new = depth <= d
            grown = np.empty((1 + np.count_nonzero(new), len(self.book)), dtype=np.int64)
            grown[0] = self.sums[d]
            step = parts[new, d][:, None] - self.book[:, d]
            np.add(sums[node[new]], step * step, out=grown[1:])
            sums, node = grown, np.cumsum(new)
            self.sums[d] = sums[node[-1]]
        self.last = parts[-1]
        return sums[node]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal, null-free lists as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """``id, label, v`` of the rows that can be coded (``v``: whole numbers), and the width."""
    vector = F.col(f"`{vector_col}`")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("x")).where(
        vector.isNotNull() & ~bad
    )
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x")).head()
    width = first[0] if first else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    most = float(math.isqrt((2**63 - 1) // max(width, 1)) // 2)
    whole = F.transform("x", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-most)), F.lit(most))).cast("int"))
    kept = rows.where(F.size("x") == width).select("id", "label", whole.alias("v"))
    return materialize(kept, "whole-vectors"), width


def learned(rows: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x part width) after ``rounds`` rounds over all rows."""
    size = width // parts
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in seeds], dtype=np.int64).reshape(len(seeds), parts, size).transpose(1, 0, 2).copy()
    if not size:
        return books
    cut = F.array(*[
        F.struct(F.lit(p).alias("at"), F.slice("v", p * size + 1, size).alias("part")) for p in range(parts)
    ])
    distinct = rows.select(F.inline(cut)).groupBy("at", "part").agg(F.count(F.lit(1)).alias("n"))
    trie = materialize(distinct.repartitionByRange("at", "part").sortWithinPartitions("at", "part"), "distinct-parts")
    for _ in range(rounds):
        for at, entry, place, n, total in _moved(trie, books).collect():
            books[at, entry, place] = int(total) // int(n)
    return books


def _moved(trie: DataFrame, books: np.ndarray) -> DataFrame:
    """``at, entry, place, n, total``: per component of every used entry, the count and the sum of its parts."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(books.shape[:2], dtype=np.int64)
        sums = np.zeros_like(books)
        path, here = None, -1
        for batch in batches:
            for begin in range(0, len(batch), BLOCK):
                block = batch.slice(begin, BLOCK)
                where = block.column("at").to_numpy(zero_copy_only=False)
                values, weight = _matrix(block.column("part")), block.column("n").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(where)) + 1), len(where)]
                for a, b in zip(cuts, cuts[1:]):
                    if where[a] != here:
                        here = int(where[a])
                        path = Path(books[here])
                    nearest = path.distances(values[a:b]).argmin(axis=1)
                    np.add.at(counts[here], nearest, weight[a:b])
                    np.add.at(sums[here], nearest, values[a:b] * weight[a:b, None])
        at, entry = np.nonzero(counts)
        size = books.shape[2]
        columns = [np.repeat(at, size), np.repeat(entry, size), np.tile(np.arange(size), len(at)), np.repeat(counts[at, entry], size), sums[at, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "entry", "place", "n", "total"])

    found = trie.mapInArrow(gathered, "at bigint, entry bigint, place bigint, n bigint, total bigint")
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    return found.groupBy("at", "entry", "place").agg(F.sum("n").alias("n"), exact.alias("total"))


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, codes, error``: nearest entries in part order, and their squared distances summed up."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, size = books.shape
        for batch in batches:
            for begin in range(0, len(batch), BLOCK):
                block = batch.slice(begin, BLOCK)
                values = _matrix(block.column("v"))
                codes = np.zeros((len(block), parts), dtype=np.int64)
                error = np.zeros(len(block), dtype=np.int64)
                for p in range(parts if size else 0):
                    part = values[:, p * size : (p + 1) * size]
                    order = np.lexsort(part.T[::-1])
                    distances = Path(books[p]).distances(part[order])
                    codes[order, p] = distances.argmin(axis=1)
                    error[order] += distances.min(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * parts), pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("label"), lists, pa.array(error)], ["id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(nearest, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error bigint")


def vector_codes(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """``id_col, label_col, codes, error, label_error`` of every row with a usable vector, and the codebooks.

    A row is left out when its vector is null or holds a null, NaN or infinite component, or when it
    is not as long as that of the smallest id. A component x counts as floor(4096 x), held inside the
    range in which the distance of two vectors fits in a long (beyond +-32,768 for 64 components).
    Codebooks begin as the parts of the rows with the smallest ids; a null id comes last, rows of equal
    ids are ordered by their vectors, and with fewer rows there are fewer entries. Equal distances go
    to the lower entry. ``label_error`` sums the errors of equal labels; null labels are one label, a
    sum beyond a long counts as the largest long. Repeated rows count each. An empty table gives no
    rows and no entries, empty vectors give codes of 0. Extra columns are ignored.
    """
    rows, width = usable(vectors, id_col, vector_col, label_col, parts)
    books = learned(rows, width, parts=parts, entries=entries, rounds=rounds)
    found = materialize(coded(rows, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint")
    totals = materialize(found.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"
    ), books


def decoded(codes: DataFrame, books: np.ndarray, *, codes_col: str = "codes") -> DataFrame:
    """Add ``vector``: the components that the codes stand for."""
    listed = [[[float(x) / SCALE for x in entry] for entry in book] for book in books]
    entry = [F.get(F.array(*[F.array(*map(F.lit, e)) for e in book]), F.col(codes_col)[p]) for p, book in enumerate(listed)]
    return codes.withColumn("vector", F.concat(*entry))

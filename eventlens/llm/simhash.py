"""Near duplicates by SimHash, with an exact tiled comparison of all fingerprints.

A bit of a fingerprint is 1 where more than half of the text's shingle hashes have it set. Equal
fingerprints are one row from there on, so groups of copies cost nothing. Fingerprints are compared
in tiles: exclusive-or and bit counts of whole arrays. Two rules skip tile pairs without a look into
them, and neither can skip a link:

* Two fingerprints that differ in at most ``RADIUS`` bits agree in all but ``RADIUS`` of any cut into
  blocks of bits. A stripe is a choice of the other blocks and their values; only tiles of the same
  stripe are compared. More blocks (for more fingerprints) give longer values and smaller stripes.
* A stripe beyond ``TILE`` fingerprints is cut by population count, then by a hash. Tiles whose
  population counts differ by more than the radius are not compared.

Links leave a tile as a forest, never as all pairs: each tile names one neighbour per fingerprint, and
tile pairs link only what the tiles themselves have not already joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.near_dedup import components
from eventlens.session import materialize

WORDS = 3
SEED = 42
RADIUS = 3
TILE = 2048
# Fingerprints that one value of a stripe may have on average before more blocks are cut.
PER_STRIPE = 64
MAX_EDGES = 1 << 20


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 255 * 64):
        some = hashes[a : a + 255 * 64]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(some) // 255 * 255
        runs = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
        total += runs.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return total


def simhash(raw: bytes, width: int = WORDS) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths)[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops[width - 1 :].tolist())]
    ones = _bit_sums(np.array(found, dtype=np.uint64)) * 2 > len(found)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc, fp``: the fingerprint (as a signed number) of every whole text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), words) for t in batch.column("t")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found.view(np.int64))], ["doc", "fp"])

    return slim.mapInArrow(hashed, f"doc {slim.schema['doc'].dataType.simpleString()}, fp bigint")


def stripe_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bits (signed) that two linked fingerprints must share, one of the masks at least."""
    blocks = radius + 1
    while blocks < 2 * radius and n > PER_STRIPE << (64 * (blocks - radius) // blocks):
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    of_block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(of_block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) of the components of links between places 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for ends in (a, b, before[a], before[b]):
            np.minimum.at(label, ends, low)
        label = label[label]
        if np.array_equal(label, before):
            member = np.flatnonzero(label != np.arange(n))
            return member, label[member]


def links_inside(values: np.ndarray, offsets: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (places in ``values``) of the links inside each of many tiles."""
    end = np.repeat(offsets[1:], np.diff(offsets))
    first = np.arange(len(values))
    a, b, held = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    distance = 1
    while True:
        first = first[first + distance < end[first]]
        if not len(first):
            break
        near = first[np.bitwise_count(values[first] ^ values[first + distance]) <= radius]
        a.append(near)
        b.append(near + distance)
        held += len(near)
        if held > MAX_EDGES:
            star = _forest(np.concatenate(a), np.concatenate(b), len(values))
            a, b, held = [star[0]], [star[1]], len(star[0])
        distance += 1
    return _forest(np.concatenate(a), np.concatenate(b), len(values))


def links_across(left: np.ndarray, right: np.ndarray, parts: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Components (of ``parts``, one label per fingerprint) that a tile pair links, as star edges."""
    names, place = np.unique(np.concatenate(parts), return_inverse=True)
    if len(names) < 2:
        return names[:0], names[:0]
    of_left, of_right = place[: len(left)], place[len(left) :]
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for begin in range(0, len(left), 256):
        near = np.bitwise_count(left[begin : begin + 256, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        x, y = of_left[begin + i], of_right[j]
        apart = x != y
        a, b = _forest(np.concatenate([a, x[apart]]), np.concatenate([b, y[apart]]), len(names))
    return names[a], names[b]


def _list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), offsets - offsets[0]


def tiles(distinct: DataFrame, masks: list[int], tile: int = TILE) -> DataFrame:
    """``stripe, value, pop, sub, fp``: the tile of every fingerprint in each stripe. Stripes within
    ``tile`` fingerprints are one tile (``pop`` -1)."""
    shares = F.array(*[F.struct(F.lit(i).alias("stripe"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.inline(shares)).select("stripe", "value", F.bit_count("fp").alias("pop"), "fp")
    cells = materialize(rows.groupBy("stripe", "value", "pop").agg(F.count(F.lit(1)).alias("n")), "stripe-cells")
    large = cells.groupBy("stripe", "value").agg(F.sum("n").alias("all")).where(F.col("all") > tile).select("stripe", "value")
    split = materialize(cells.join(large, ["stripe", "value"], "left_semi"), "large-cells")
    subs = F.ceil(F.col("n") / tile)
    return rows.join(split, ["stripe", "value", "pop"], "left").select(
        "stripe", "value", F.when(F.col("n").isNull(), -1).otherwise(F.col("pop")).cast("int").alias("pop"),
        F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), subs)).cast("bigint").alias("sub"), "fp",
    )


def near_links(distinct: DataFrame, masks: list[int], *, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc, comp`` of every fingerprint (``fp``, no two equal) that is linked with another one."""
    key = ["stripe", "value", "pop", "sub"]
    placed = materialize(tiles(distinct, masks, tile), "tiles")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _list_column(batch.column("fps"))
            a, b = links_inside(values, offsets, radius)
            signed = values.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"])

    grouped = placed.groupBy(*key).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    links = materialize(grouped.mapInArrow(inside, "a bigint, b bigint").distinct(), "tile-links")
    found = components(links)
    large = placed.where(F.col("pop") >= 0)
    if large.isEmpty():
        return found
    # Tiles of one large stripe against each other; what is joined already needs no link.
    label = found.select(F.col("doc").alias("fp"), "comp")
    rows = large.join(label, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    packed = materialize(rows.groupBy(*key).agg(F.collect_list(F.struct("fp", "comp")).alias("rows")), "large-tiles")
    ids = packed.select(*key)
    ahead = ids.select("stripe", "value", F.col("pop").alias("pa"), F.col("sub").alias("sa"), F.explode(F.sequence("pop", F.col("pop") + radius)).alias("pop"))
    pairs = ahead.join(ids, ["stripe", "value", "pop"]).where((F.col("pa") < F.col("pop")) | (F.col("sa") < F.col("sub")))
    one = packed.select("stripe", "value", F.col("pop").alias("pa"), F.col("sub").alias("sa"), F.col("rows").alias("left"))
    both = (
        pairs.repartition(*key, "pa", "sa").join(one, ["stripe", "value", "pa", "sa"])
        .join(packed, key).select("left", F.col("rows").alias("right"))
    )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = (np.array([(r["fp"], r["comp"]) for r in side.as_py()], dtype=np.int64) for side in (left, right))
                a, b = links_across(x[:, 0].copy().view(np.uint64), y[:, 0].copy().view(np.uint64), (x[:, 1], y[:, 1]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    more = materialize(both.mapInArrow(across, "a bigint, b bigint").distinct(), "tile-pair-links")
    if more.isEmpty():
        return found
    stars = found.where(F.col("doc") != F.col("comp")).select(F.col("doc").alias("a"), F.col("comp").alias("b"))
    return components(stars.unionByName(more))


def simhash_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; ``fp`` is the fingerprint as a signed number.

    Texts (A-Z lower-cased, words between ASCII white space) are cut into ``words``-word shingles,
    repeats included; a shorter text is one shingle, and a null, empty or blank one has the
    fingerprint zero, which is linked like any other. Documents whose fingerprints differ in at
    most ``radius`` bits are linked; ``component_id`` is the smallest id reachable, itself included. A
    row with a null id is linked like any other and names no component: its group takes the smallest
    id that is there, or null. Repeated rows and rows that share an id each give a row. An empty table
    gives no rows. Extra columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "simhashes")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc").alias("least")), "distinct-simhashes")
    found = near_links(distinct.select("fp"), stripe_masks(distinct.count(), radius), radius=radius, tile=tile)
    label = found.select(F.col("doc").alias("fp"), "comp")
    named = distinct.join(label, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    ends = materialize(named.select("fp", "comp").join(smallest, "comp").select("fp", "component_id"), "simhash-groups")
    return rows.join(ends, "fp").select(F.col("doc").alias(id_col), "fp", "component_id")

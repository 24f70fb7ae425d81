"""Near duplicates by one-permutation MinHash, banded buckets and verified stars.

A document's distinct word shingles are hashed once; the hash range is cut into ``BINS`` bins and the
smallest hash of each bin is its value. Empty bins borrow from the first non-empty bin in a random
order of their own (optimal densification). ``BANDS`` bands of ``ROWS`` bins are bucket keys: a pair of
similarity s meets in no bucket with probability (1 - s^ROWS)^BANDS, below 1e-8 at 0.8, and in one with
1.5 % at 0.2, so that documents which only share a common passage seldom meet.

Documents with the same words are put together first, so hot groups of copies are one document. In
a bucket only a star is compared: the document that meets most others against the rest, and the rest
against the best of their centres before the others, which are left out where they are in one component by then. Buckets that
then hold more than one component go on. Among their documents, two that are similar share one of
their rarest shingles (a share of 1 - s of a set, plus one, cannot be missed by both), so these make
new, smaller buckets, in which documents outside of the largest component become centres until every
bucket holds one component or all its pairs were compared. Documents that have a frequent passage and
nothing else in common part here; pairs inside a component that is already joined are never listed,
and no link between two components is missed. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import lean
from eventlens.session import materialize

WORDS = 5
PERCENT = 80
BANDS = 48
ROWS = 5
BINS = BANDS * ROWS
# Centres per unresolved bucket in the rounds after the first.
CENTRES = (4, 64, 1024)
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _bins() -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the bins, and per bin the random order in which it asks others for a value."""
    rng = np.random.default_rng(2017)
    bounds = np.array([b * 2**64 // BINS for b in range(BINS)], dtype=np.uint64)
    return bounds, np.stack([rng.permutation(BINS) for _ in range(BINS)])


def _densified(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    order = _bins()[1]
    empty = np.flatnonzero(~full)
    for attempt in range(BINS):
        if not len(empty):
            break
        lender = order[empty, attempt]
        lends = full[lender]
        values[empty[lends]] = values[lender[lends]]
        empty = empty[~lends]
    return values


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a run of texts, and where each text's shingles begin.

    ``data`` holds the bytes of the texts, text i from ``offsets[i]`` to ``offsets[i + 1]``.
    """
    low = _LOWER[data]
    inside = ~_BLANK[low]
    begins, ends = inside.copy(), inside.copy()
    edge = np.zeros(len(low) + 1, dtype=bool)  # where another text begins
    edge[offsets] = True
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(1 << max(20, int(len(low)).bit_length()))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)])))
    word = _mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)  # of each text, in words
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    begin = np.concatenate(([0], np.cumsum(n_shingles)))
    text = np.repeat(np.arange(len(n_words)), n_shingles)
    at = first[:-1][text] + (np.arange(begin[-1]) - begin[:-1][text])
    total = np.zeros(len(at), dtype=np.uint64)
    length = np.minimum(n_words, width)[text]
    for i in range(width):
        there = length > i
        part = word[np.minimum(at + i, len(word) - 1)] if len(word) else word
        total += np.where(there, _mixed(part + np.uint64((i + 1) * _BASE % 2**64)), np.uint64(0))
    return _mixed(total), begin


def signature(found: np.ndarray) -> np.ndarray:
    """Values of all bins of a non-empty set of sorted distinct hashes."""
    place = np.searchsorted(found, _bins()[0])
    full = np.diff(np.append(place, len(found))) > 0
    return _densified(found[np.minimum(place, len(found) - 1)], full)


def bands(shingles: np.ndarray) -> tuple[int, np.ndarray | None]:
    """Size of the set and its bucket keys (None for an empty set)."""
    found = np.unique(shingles)
    if not len(found):
        return 0, None
    keys = signature(found).reshape(BANDS, ROWS)
    weights = _mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    return len(found), _mixed((keys * weights).sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHUNK`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, b
        a = b


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, n, copy, bands``: set size, a digest of the word sequence, bucket keys."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("t"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t").cast(pa.large_binary())
            _, where, content = column.buffers()
            offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
            sizes, keys, copies = [], [], []
            for a, b in _chunks(offsets):
                part = offsets[a : b + 1]
                bytes_ = data[part[0] : part[-1]]
                hashes, begin = shingle_hashes(bytes_, part - part[0], width)
                for i in range(b - a):
                    n, key = bands(hashes[begin[i] : begin[i + 1]])
                    sizes.append(n)
                    keys.append(key)
                    raw = bytes_[part[i] - part[0] : part[i + 1] - part[0]].tobytes()
                    copies.append(hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest())
            columns = [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(copies, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "copy", "bands"])

    kind = slim.schema["doc"].dataType.simpleString()
    return slim.mapInArrow(lean(sketch), f"doc {kind}, n bigint, copy binary, bands array<bigint>")


def shingle_set(raw: bytes, width: int) -> set[tuple[bytes, ...]]:
    words = raw.lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a, b``) whose full shingle sets are similar enough."""
    left = texts.select(F.col("doc").alias("b"), F.col("t").alias("tb"))
    right = texts.select(F.col("doc").alias("a"), F.col("t").alias("ta"))
    both = pairs.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for batch in batches:
            good = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb")):
                ta, tb = ta.as_py(), tb.as_py()
                if ta != last:  # the rows of a centre come one after the other
                    last, kept = ta, shingle_set(ta, width)
                other = shingle_set(tb, width)
                shared = len(kept & other)
                good.append(100 * shared >= percent * (len(kept) + len(other) - shared))
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield rows.filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(lean(check), f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """``doc, comp``: the smallest document reachable, for every document with a link.

    Each step takes the smallest of the labels of the neighbours and of the label's own label, so the
    number of steps follows the logarithm of a chain's length; a star takes one. Every step is a
    written table and one join.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(edges.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        own = labels.select(F.col("doc").alias("a"), F.col("comp").alias("b"), F.col("comp").alias("old"))
        reached = edges.withColumn("old", F.lit(None).cast(own.schema["old"].dataType)).unionByName(own)
        known = labels.select(F.col("doc").alias("b"), "comp")
        lower = reached.join(known, "b").groupBy(F.col("a").alias("doc")).agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        after = materialize(lower.select("doc", "comp", (F.col("comp") < F.col("old")).alias("moved")), "labels")
        labels = after.select("doc", "comp")
        if after.where("moved").isEmpty():
            return labels


def stars_of(found: DataFrame) -> DataFrame:
    """Components as links to their smallest document: later links are added to these, not to all earlier ones."""
    return found.where(F.col("doc") != F.col("comp")).select(F.col("doc").alias("a"), F.col("comp").alias("b"))


def rarest(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``key, doc, n, place, sketch``: the shingles of each text that stand in fewest of the texts, as
    many as two similar texts cannot both be without; those of one text alone are left out. ``place``
    counts them from the rarest, ``sketch`` has a byte of every bin's value."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t").cast(pa.large_binary())
            _, where, content = column.buffers()
            offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
            for a, b in _chunks(offsets):
                part = offsets[a : b + 1]
                hashes, begin = shingle_hashes(data[part[0] : part[-1]], part - part[0], width)
                sets = [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(b - a)]
                sketches = [(signature(x) & np.uint64(255)).astype(np.uint8).view(np.int8) if len(x) else None for x in sets]
                columns = [
                    batch.column("doc").slice(a, b - a), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int8())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "keys", "sketch"])

    kind = texts.schema["doc"].dataType.simpleString()
    sets = materialize(
        texts.select("doc", "t").mapInArrow(lean(shingles), f"doc {kind}, keys array<bigint>, sketch array<tinyint>"), "open-sets"
    )
    rows = sets.select("doc", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    common = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("df", "key"))
    counted = rows.join(common, "key", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", place)
    enough = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    rare = counted.where((F.col("place") <= enough) & (F.col("df") > 1)).select("key", "doc", "n", "place")
    return materialize(rare.join(sets.select("doc", "sketch"), "doc"), "rare-shingles")


def _possible(percent: int) -> Column:
    """Whether a row and a centre (``x``-columns) that meet at a rare shingle can be similar: by the
    shingles that are left behind it, and by the share of equal sketch bytes, six standard
    deviations below what it is for similar sets (missed with a probability below 1e-8)."""
    share = percent / 100
    behind = 1 + F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("place"))
    needed = F.ceil(F.lit(percent) * (F.col("n") + F.col("nx")) / (100 + percent))
    equal = F.size(F.filter(F.zip_with("sketch", "sx", lambda a, b: a == b), lambda same: same))
    spread = F.sqrt(F.lit(share * (1 - share)) / F.least("n", "nx", F.lit(BINS)))
    return (behind >= needed) & (equal >= BINS * (share - 6 * spread))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Two documents are linked when their sets of distinct ``words``-word shingles (A-Z lower-cased,
    words between ASCII white space; a text with fewer words is one shingle) have a Jaccard
    similarity of at least ``percent`` / 100. ``component_id`` is the smallest id reachable over
    links, itself included; ``kept`` marks it. A null, empty or blank text has no shingle and no
    link. A row with a null id is kept, has no component and is linked with nothing. Rows that share
    an id are one document: a link of one is a link of all. Extra columns are ignored.
    """
    sketched = materialize(sketches(docs, words, id_col, text_col), "sketches")
    usable = sketched.where((F.col("n") > 0) & F.col("doc").isNotNull())
    copies = usable.groupBy("copy").agg(F.min("doc").alias("rep"))
    members = materialize(
        usable.join(copies, "copy").select(
            "doc", "rep", "n", F.when(F.col("doc") == F.col("rep"), F.col("bands")).alias("bands")
        ),
        "copies",
    )
    # One row per document and bucket; buckets with one document are gone after the first shuffle.
    placed = members.where(F.col("bands").isNotNull()).select("doc", "n", F.explode("bands").alias("key"))
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("least"), F.max("doc").alias("last"))
    sizes = sizes.where(F.col("least") < F.col("last")).select("key", "size")
    shared = materialize(placed.join(sizes, "key"), "buckets")
    # The document that meets most others stands nearest to the middle of its group: as the centre
    # of all its buckets it links nearly the whole group in the first round.
    rank = shared.groupBy("doc").agg(F.sum("size").alias("rank"))
    ranked = materialize(shared.select("key", "doc", "n").distinct().join(rank, "doc"), "ranked-buckets")
    stars = ranked.groupBy("key").agg(F.max_by(F.struct("doc", "n", "rank"), F.struct("rank", "key", "doc")).alias("centre"))
    active = ranked.join(stars, "key").select(
        "key", "doc", "n", "rank", F.col("centre.doc").alias("centre"), F.col("centre.n").alias("nc"), F.col("centre.rank").alias("rc")
    )
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("t"))
    involved = rank.select("doc")
    texts = materialize(source.join(involved, "doc", "left_semi"), "candidate-texts")

    def able(a: str, b: str) -> Column:
        """Sizes so different that no similarity is possible are left out."""
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    spokes = active.where((F.col("doc") != F.col("centre")) & able("n", "nc"))

    def in_order(one: str, other: str) -> list[Column]:
        return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]

    # Each document meets the best of its centres first, and another one only if that is not yet in its component.
    best = spokes.groupBy("doc").agg(F.max_by("centre", F.struct("rc", "centre")).alias("centre"))
    links = materialize(confirmed(best.select(*in_order("doc", "centre")).distinct(), texts, words, percent), "confirmed")
    found = components(links)
    ends = found.select("doc", "comp")
    other = spokes.select("doc", "centre").distinct().join(best, ["doc", "centre"], "left_anti")
    apart = (
        other.join(ends.withColumnRenamed("comp", "c1"), "doc", "left")
        .join(ends.select(F.col("doc").alias("centre"), F.col("comp").alias("c2")), "centre", "left")
        .where(F.coalesce("c1", "doc") != F.coalesce("c2", "centre"))
    )
    more = materialize(confirmed(apart.select(*in_order("doc", "centre")).distinct(), texts, words, percent), "confirmed")
    if not more.isEmpty():
        found = components(stars_of(found).unionByName(more))
    # A centre has met all others of its bucket; the rest of an open bucket is looked at again.
    rest = active.where(F.col("doc") != F.col("centre")).join(found.select("doc", "comp"), "doc", "left")
    comp = F.coalesce("comp", "doc")
    undone = rest.groupBy("key").agg(F.min(comp).alias("low"), F.max(comp).alias("high")).where(F.col("low") < F.col("high"))
    left = materialize(rest.join(undone.select("key"), "key", "left_semi").select("doc").distinct(), "open-documents")
    if not left.isEmpty():
        active = rarest(texts.join(left, "doc", "left_semi"), words, percent)
    else:
        active = left.where("false").selectExpr("0L key", "doc", "0 n", "0 place", "array(0Y) sketch")
    step = 0
    while True:
        known = found.select("doc", "comp")
        here = active.join(known, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        per_comp = here.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
        mixed = per_comp.groupBy("key").agg(
            F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")
        ).where(F.col("comps") > 1)
        open_ = materialize(here.join(mixed.select("key", F.col("top.comp").alias("top")), "key"), "open-buckets")
        if open_.isEmpty():
            break
        order = Window.partitionBy("key").orderBy(F.xxhash64("doc"), "doc")
        centres = materialize(
            open_.where(F.col("comp") != F.col("top")).withColumn("turn", F.row_number().over(order))
            .where(F.col("turn") <= CENTRES[min(step, len(CENTRES) - 1)])
            .select(
                "key", F.col("doc").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"),
                F.col("sketch").alias("sx"),
            ),
            "centres",
        )
        met = open_.join(centres, "key").where((F.col("comp") != F.col("cx")) & able("n", "nx") & _possible(percent))
        pairs = met.select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b")).distinct()
        more = materialize(confirmed(pairs, texts, words, percent), "confirmed")
        if not more.isEmpty():
            found = components(stars_of(found).unionByName(more))
        active = open_.select(*active.columns).join(
            centres.select("key", F.col("x").alias("doc")), ["key", "doc"], "left_anti"
        )
        step += 1
    ends = found.select(F.col("doc").alias("rep"), F.col("comp").alias("component_id"))
    per_doc = members.select("doc", "rep").join(ends, "rep", "left").groupBy("doc").agg(
        F.min(F.coalesce("component_id", "rep")).alias("component_id")
    )
    return sketched.select("doc", F.col("n").alias("n_shingles")).join(per_doc, "doc", "left").select(
        F.col("doc").alias(id_col), "n_shingles",
        F.coalesce("component_id", "doc").alias("component_id"),
        F.coalesce(F.col("doc") == F.coalesce("component_id", "doc"), F.lit(True)).alias("kept"),
    )

"""Packing of token pieces into sequences of a fixed capacity, planned on the histogram of lengths.

Pattern packing: patterns of few lengths that fill a sequence exactly are enumerated, non-negative
least squares fits how often each should be used so that together they reproduce the histogram, the
fit is rounded down, and what is left is packed by filling each sequence with the longest pieces that
fit. The plan only knows lengths and counts, so its size depends on the capacity and not on the
corpus. Every piece then gets its ordinal among the pieces of its length (a distributed rank) and
looks its place up in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import hash_slice, lean, prefix_sums, slices_for
from eventlens.llm.tokens import WordEncoder, word_encoder
from eventlens.session import materialize

CAPACITY = 4096
END_ID = 1
# Characters of texts that are encoded together.
GROUP = 1 << 18
FEW = 4
SPREAD = 12
SWEEPS = 25
# Shares of the fit that are tried; the plan with the fewest sequences is taken.
SHARES = (1.0, 0.9, 0.7, 0.4)

Pattern = tuple[int, ...]


def patterns(lengths: list[int], capacity: int) -> list[Pattern]:
    """Patterns of at most ``FEW`` of the lengths that add up to the capacity exactly.

    For every largest member and number of members, ``SPREAD`` choices of the middle members.
    """
    there = set(lengths)
    ordered = np.array(sorted(there))
    found: set[Pattern] = {(capacity,)} if capacity in there else set()

    def extend(chosen: Pattern, gap: int) -> None:
        if gap <= chosen[-1] and gap in there:
            found.add((*chosen, gap))
        if len(chosen) + 2 > FEW:
            return
        fits = ordered[: np.searchsorted(ordered, min(gap - 1, chosen[-1]), side="right")]
        for i in np.unique(np.linspace(0, len(fits) - 1, SPREAD if len(chosen) == 1 else 3).astype(int)) if len(fits) else ():
            extend((*chosen, int(fits[i])), gap - int(fits[i]))

    for length in ordered[ordered < capacity]:
        extend((int(length),), capacity - int(length))
    return sorted(found, reverse=True)


def fit_repeats(found: list[Pattern], counts: dict[int, int]) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeats of each pattern."""
    left = {length: float(n) for length, n in counts.items()}
    uses = [tuple(Counter(p).items()) for p in found]
    norms = [sum(k * k for _, k in u) for u in uses]
    repeats = [0.0] * len(found)
    for _ in range(SWEEPS):
        for j, u in enumerate(uses):
            step = sum(k * left[length] for length, k in u) / norms[j]
            step = max(step, -repeats[j])
            if step:
                repeats[j] += step
                for length, k in u:
                    left[length] -= step * k
    return np.array(repeats)


def fill(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest piece first, then the longest that fits, repeated as often as the counts allow."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lower = list(range(capacity + 1))  # the nearest length with pieces left, at or below

    def nearest(x: int) -> int:
        path = []
        while x > 0 and left[x] == 0:
            if lower[x] == x:
                lower[x] = x - 1
            path.append(x)
            x = lower[x]
        for p in path:
            lower[p] = x
        return x

    out = []
    while (top := nearest(capacity)) > 0:
        chosen, gap = Counter([top]), capacity - top
        x = nearest(min(gap, top))
        while x > 0:
            k = min(gap // x, int(left[x]) - chosen[x])
            if k > 0:
                chosen[x] += k
                gap -= k * x
            x = nearest(min(gap, x - 1))
        m = min(int(left[length]) // k for length, k in chosen.items())
        for length, k in chosen.items():
            left[length] -= m * k
        out.append((tuple(sorted(chosen.elements(), reverse=True)), m))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns with repeats that use every length exactly ``counts`` times."""
    counts = {length: n for length, n in counts.items() if n}
    found = patterns(list(counts), capacity)
    repeats = fit_repeats(found, counts)
    best: list[tuple[Pattern, int]] | None = None
    for share in SHARES:
        left, out = dict(counts), []
        for j in np.argsort(-repeats, kind="stable"):
            m = int(repeats[j] * share)
            if m < 1:
                break
            uses = Counter(found[j])
            m = min([m, *(left[length] // k for length, k in uses.items())])
            if m > 0:
                out.append((found[j], m))
                for length, k in uses.items():
                    left[length] -= m * k
        out += fill(left, capacity)
        if best is None or sum(m for _, m in out) < sum(m for _, m in best):
            best = out
    return best or []


def _runs(encoder: WordEncoder, column: pa.Array) -> Iterator[bytes]:
    """Ids of the texts in order, encoded in groups of texts of about ``GROUP`` bytes."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py())
        size += len(held[-1])
        if size >= GROUP:
            yield from encoder.many(held)
            held, size = [], 0
    yield from encoder.many(held)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``,
    little-endian unsigned 32-bit). A document's ids end with ``END_ID``; a null or empty text is
    that id alone. Repeated rows give repeated pieces."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    end = np.array([END_ID], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        for batch in batches:
            rows, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
            for row, encoded in enumerate(_runs(encode, batch.column("t"))):
                whole = memoryview(encoded + end)
                for p, start in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[start : start + 4 * capacity]
                    rows.append(row)
                    pieces.append(p)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(bytes(part))
            columns = [
                batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                *[pa.array(c, pa.int64()) for c in (starts, lengths, crcs)], *([pa.array(ids, pa.binary())] if with_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return slim.mapInArrow(lean(cut), schema)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, length, ids_crc32``, others kept).

    ``pieces`` is read three times, so it should be a written table. Equal pieces are interchangeable.
    """
    tallies = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    table: list[tuple[int, int, int, int]] = []  # length, first ordinal, first sequence, offset
    used: Counter[int] = Counter()
    sequences = 0
    for pattern, repeats in plan({r["length"]: r["n"] for r in tallies}, capacity):
        offset = 0
        for length in pattern:
            table.append((length, used[length], sequences, offset))
            used[length] += repeats
            offset += length
        sequences += repeats
    table.sort()
    keys = np.array([(row[0] << 48) + row[1] for row in table], dtype=np.int64)
    firsts, bases, offsets = (np.array([row[i] for row in table], dtype=np.int64) for i in (1, 2, 3))
    looked_up = pieces.sparkSession.sparkContext.broadcast((keys, firsts, bases, offsets))  # bounded by the capacity
    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    sliced = pieces.withColumn("__h", h).withColumn("__slice", hash_slice(F.col("__h"), slices_for(sum(r["n"] for r in tallies))))
    ranked = prefix_sums(sliced, ["length"], "__slice", ["__h", "doc_id", "piece"], F.lit(1), "__ordinal")
    out = ranked.select(*pieces.columns, "__ordinal")
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, bases, offsets = looked_up.value
        for batch in batches:
            ordinal = batch.column("__ordinal").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, (length << 48) + ordinal, side="right") - 1
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bases[i] + ordinal - firsts[i]), pa.array(offsets[i])], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return out.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """All documents as placed pieces: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    Null and empty texts are one end id; a null id is an id like any other; repeated rows are packed
    as often as they stand there; an empty table gives no rows; extra columns are ignored.
    """
    cut = token_pieces(docs, tokenizer_path, capacity=capacity, id_col=id_col, text_col=text_col, with_ids=with_ids)
    return placed(materialize(cut, "token-pieces"), capacity)

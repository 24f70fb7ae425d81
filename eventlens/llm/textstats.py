"""Statistics of one text, counted over all its bytes. Used inside tasks, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import lean

COUNTS = (
    "n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
    "n_upper", "n_lower", "n_digits", "n_stops", "n_marks", "n_bars", "n_other", "n_top_word", "n_edge_symbols",
)
WINDOW = 5

_BLANKS = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_STOPS = np.frombuffer(b".,;:", dtype=np.uint8)
_MARKS = np.frombuffer(b"!?", dtype=np.uint8)
_EDGES = frozenset(b"#*$%&|<>!")


def repeat_words(ids: np.ndarray, n_kinds: int) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    if len(ids) <= WINDOW:
        return 0
    grams, kinds, width = ids, n_kinds, 1
    # numbers for ever longer windows; equal numbers are equal windows, without any hashing
    for step in (1, 2, 1):
        tail = grams[step:] if step == width else ids[width:]
        scale = kinds if step == width else n_kinds
        joined = grams[: len(tail)] * scale + tail
        found, grams, counts = np.unique(joined, return_inverse=True, return_counts=True)
        if len(found) == len(joined):
            return 0
        kinds, width = len(found), width + step
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[grams] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def count_text(raw: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of one UTF-8 text."""
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if raw else np.zeros(256, dtype=np.int64)
    points = len(raw) - int(seen[0x80:0xC0].sum())
    words = raw.split()
    n = len(words)
    place: dict[bytes, int] = dict.fromkeys(words, 0)
    place.update(zip(place, range(len(place))))
    ids = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper, lower, digits = (int(seen[a : b + 1].sum()) for a, b in ((65, 90), (97, 122), (48, 57)))
    blanks, symbols = int(seen[_BLANKS].sum()), int(seen[_SYMBOLS].sum())
    stops, marks = int(seen[_STOPS].sum()), int(seen[_MARKS].sum())
    wide = int(seen[0xC0:].sum())
    other = points - blanks - symbols - stops - marks - upper - lower - digits - wide
    return (
        len(raw), n, points - blanks, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(ids, len(place)),
        len(place), upper, lower, digits, stops, marks, int(seen[124]), other,
        int(np.bincount(ids).max()) if n else 0, sum(w[-1] in _EDGES for w in words),
    )


def counts_table(raw: pa.Array) -> np.ndarray:
    """Texts x ``COUNTS``; a null counts as empty."""
    counted = [count_text(text.as_py() or b"") for text in raw]
    return np.array(counted, dtype=np.int64).reshape(len(counted), len(COUNTS))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = counts_table(batch.column(batch.num_columns - 1))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        counted = [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays(kept + counted, batch.schema.names[:-1] + list(COUNTS))


def with_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns (renamed to ``k0, k1, ...``) with the ``COUNTS`` of the text; a null text counts as empty."""
    raw = F.col(f"`{text_col}`").cast("string").cast("binary").alias("__raw")
    slim = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], raw)
    fields = [f"k{i} {slim.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return slim.mapInArrow(lean(_count), ", ".join(fields + [f"{c} bigint" for c in COUNTS]))

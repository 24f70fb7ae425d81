"""Bucket lookups that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# History-length edges of the shard layout.
LENGTH_EDGES = (1, 50, 500)


def bucket_index(value: Column, bounds: Sequence[float]) -> Column:
    """How many bounds are <= value, as a balanced tree of comparisons.

    log2(n) comparisons a row and no lambda, so it compiles with the scan stage.
    """

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(float(bounds[mid])), search(mid + 1, hi)).otherwise(
            search(lo, mid)
        )

    return search(0, len(bounds))


def numeric_token(value: Column, bounds: Sequence[float], base_id: int, n_buckets: int) -> Column:
    """Zero has its own id; otherwise the bucket, values on a bound going up."""
    index = F.least(bucket_index(value, bounds), F.lit(n_buckets - 1))
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(value == 0.0, F.lit(base_id))
        .otherwise(F.lit(base_id + 1) + index)
        .cast("int")
    )


def length_label(n_events: Column, edges: Sequence[int] = LENGTH_EDGES) -> Column:
    """``0-0``, ``1-49``, ``50-499``, ``500+`` for the default edges."""
    out = None
    lower = 0
    for edge in edges:
        label = F.lit(f"{lower}-{edge - 1}")
        out = F.when(n_events < edge, label) if out is None else out.when(n_events < edge, label)
        lower = edge
    last = F.lit(f"{lower}+")
    return last if out is None else out.otherwise(last)

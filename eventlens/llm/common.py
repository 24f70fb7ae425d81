"""Helpers shared by the training-data operators: distributed ranks and text-column conventions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 250_000
MIN_SLICES = 64


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def slices_for(n_rows: int) -> int:
    """Slices follow the rows, so one slice stays small at any size; they never change a rank."""
    return max(MIN_SLICES, math.ceil(n_rows / ROWS_PER_SLICE))


def hash_slice(h: Column, slices: int) -> Column:
    """Slice number that grows with the signed 64-bit hash ``h``."""
    upper = F.shiftright(h, 32) + F.lit(2**31)
    return F.floor(upper * F.lit(slices) / F.lit(2**32)).cast("int")


def prefix_sums(
    df: DataFrame, by: Sequence[str], slice_col: str, order: Sequence[str], weight: Column, name: str
) -> DataFrame:
    """Add ``name``: the total weight of the earlier rows of the group.

    Rows are ordered by (``slice_col``, ``order``); a slice is one window, and the totals of the
    earlier slices are added from a table of one row per group and slice. No group and no table is
    ever one task. ``df`` is read twice, so it should be a written table. Group columns hold no null.
    """
    by = list(by)
    weighted = df.withColumn("__w", weight)
    rows = Window.partitionBy(*by, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = weighted.withColumn("__in", F.coalesce(F.sum("__w").over(rows), F.lit(0)))
    earlier = Window.partitionBy(*by).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        weighted.groupBy(*by, slice_col).agg(F.sum("__w").alias("__t"))
        .withColumn("__before", F.coalesce(F.sum("__t").over(earlier), F.lit(0)))
        .drop("__t")
    )
    joined = inside.join(totals, [*by, slice_col])
    return joined.withColumn(name, (F.col("__in") + F.col("__before")).cast("bigint")).drop("__w", "__in", "__before")


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same step for ``mapInArrow``; at the end of a task the worker hands back the memory of its batches.
    Workers outlive their tasks, and Arrow's pool would keep it through stages that have no Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()

    return run


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row: the generator keeps the optimizer from copying
    the expression into every place (and every lambda step) that uses the column."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    plain = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))

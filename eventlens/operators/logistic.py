"""Logistic regression by Newton steps over sums that do not depend on how rows lie in partitions.

Equal rows are counted once with a weight, dealt into blocks by their hash and sorted there, so a block
is the same whatever task builds it. A step sums gradient and curvature per block; block sums become whole
numbers of 2^-24 and are added exactly, per task first, then by Spark. The driver sees one number per
pair of features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.session import materialize

# Wider vectors have too many pairs of features for Newton steps.
MAX_WIDTH = 1_000
BLOCK_BYTES = 1 << 20
MAX_STEPS = 100
_SUM_BITS = 24
_MOMENT_BITS = 60


class LogisticModel(NamedTuple):
    """Weights of ``(x - mean) / std``."""

    intercept: float
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    steps: int

    def score(self, x: Column) -> Column:
        """The linear score of an array column."""
        terms = [
            (F.element_at(x, i + 1) - F.lit(m)) / F.lit(s) * F.lit(w)
            for i, (w, m, s) in enumerate(zip(self.weights, self.mean, self.std))
        ]
        return F.aggregate(F.array(F.lit(self.intercept), *terms), F.lit(0.0), lambda a, t: a + t)


def row_blocks(rows: DataFrame, x: str, y: str, n_rows: int, width: int) -> DataFrame:
    """One row per block: its distinct ``(x, y)`` in order, with the number of rows that are equal."""
    per_block = max(16, BLOCK_BYTES // (8 * (width + 2)))
    slices = max(1, -(-n_rows // per_block))
    distinct = rows.groupBy(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    return distinct.groupBy(F.pmod(F.xxhash64("x", "y"), F.lit(slices)).alias("slice")).agg(
        F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("rows")
    ).select("rows")


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block in batch.column("rows"):
            x, y, n = block.values.flatten()
            yield x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), y.to_numpy(), n.to_numpy()


def _block_sums(blocks: DataFrame, width: int, bits: int, part: Callable) -> np.ndarray:
    """The exact total over all blocks of ``part(x, y, n)``, each rounded to multiples of 2^-bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, y, n in _matrices(batches, width):
            values = np.rint(np.ldexp(part(x, y, n), bits))
            if not np.isfinite(values).all():
                raise ValueError("vectors must be finite and without nulls")
            whole = [int(v) for v in values]
            total = whole if total is None else [a + b for a, b in zip(total, whole)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total], pa.string())], ["place", "v"]
            )

    parts = blocks.mapInArrow(add, "place int, v string")
    sums = parts.groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("place").collect()
    return np.array([float(int(r["v"])) for r in sums]) * 2.0**-bits


def moments(blocks: DataFrame, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each dimension; a constant one has deviation 1."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(width)
        for x, _, _ in _matrices(batches, width):
            top = np.maximum(top, np.abs(x).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(top)], ["place", "v"])

    found = blocks.mapInArrow(largest, "place int, v double").groupBy("place").agg(F.max("v").alias("v")).orderBy("place").collect()
    # a power of two at or above the largest value brings every dimension into [-1, 1] without rounding
    unit = np.array([np.exp2(np.ceil(np.log2(r["v"]))) if r["v"] > 0 else 1.0 for r in found])
    mean = _block_sums(blocks, width, _MOMENT_BITS, lambda x, y, n: n @ (x / unit)) / n_rows
    square = _block_sums(blocks, width, _MOMENT_BITS, lambda x, y, n: n @ (x / unit - mean) ** 2) / n_rows
    std = np.sqrt(square) * unit
    return mean * unit, np.where(std > 0, std, 1.0)


def _summed(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper half of the curvature of one block; the intercept comes first."""
    ones = np.column_stack((np.ones(len(x)), (x - mean) / std))
    z = ones @ w
    p = 0.5 * (1.0 + np.tanh(0.5 * z))
    loss = n @ (np.logaddexp(0.0, z) - y * z)
    curvature = ones.T @ (ones * (n * p * (1.0 - p))[:, None])
    return np.concatenate(([loss], ones.T @ (n * (p - y)), curvature[np.triu_indices(len(w))]))


def fit_logistic(train: DataFrame, x: str, y: str, *, standardize: bool = True, l2: float = 1.0) -> LogisticModel:
    """Minimise the summed log loss plus ``l2 / 2`` times the squared weights (not the intercept).

    ``x`` is an array of numbers of one length, ``y`` is 0 or 1. Both classes must occur. Nulls and
    values that are not finite are refused. Equal rows count as often as they stand there. The result is the same for
    any partitioning of the rows.
    """
    shape = train.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size(x)).alias("low"), F.max(F.size(x)).alias("high"),
        F.count_if(F.col(y).cast("double") == 1).alias("pos"), F.count_if(F.col(y).cast("double") == 0).alias("neg"),
    ).first()
    if not shape["pos"] or not shape["neg"]:
        raise ValueError("both classes are needed")
    if shape["pos"] + shape["neg"] != shape["n"] or shape["low"] != shape["high"] or not 0 < shape["low"] <= MAX_WIDTH:
        raise ValueError(f"labels must be 0 or 1, vectors of one length from 1 to {MAX_WIDTH}")
    width, n_rows = shape["low"], shape["n"]
    blocks = materialize(row_blocks(train, x, y, n_rows, width), "row-blocks")
    mean, std = moments(blocks, width, n_rows) if standardize else (np.zeros(width), np.ones(width))
    ridge = np.full(width + 1, l2)
    ridge[0] = 0.0
    upper = np.triu_indices(width + 1)
    w, step, best = np.zeros(width + 1), np.zeros(width + 1), np.inf
    for taken in range(MAX_STEPS):
        sums = _block_sums(blocks, width, _SUM_BITS, lambda a, b, n: _summed(a, b, n, w, mean, std))
        loss = sums[0] + 0.5 * ridge @ w**2
        if loss > best + 1e-6 and np.abs(step).max() > 1e-9:  # too far: half the step
            step = step / 2
            w = w + step
            continue
        best = loss
        gradient = sums[1 : width + 2] + ridge * w
        curvature = np.zeros((width + 1, width + 1))
        curvature[upper] = sums[width + 2 :]
        curvature = curvature + np.triu(curvature, 1).T + np.diag(ridge)
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return LogisticModel(float(w[0]), tuple(w[1:].tolist()), tuple(mean.tolist()), tuple(std.tolist()), taken + 1)

"""Vectors of tokens from how often they stand in one event, the same for any partitioning.

Counts of token pairs become positive mutual information. Its leading directions are found by a
randomised range finder: hashed start vectors are multiplied with the sparse matrix a few times and made
orthogonal in between. Vectors are whole numbers of 2^-30 and sums are exact, so no result depends on the
order of rows; the driver sees one small square matrix per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.session import materialize

UNIT = 2**30
ROUNDS = 3
# Vectors of more words are joined by shuffle: 200,000 of 16 dimensions are 25 MB.
BROADCAST_NUMBERS = 3_200_000
_PRODUCT = 2.0**40
_ROWS = 4_096  # as many products stay below 2^53


def words(key_ids: Column, value_ids: Column) -> Column:
    """Key and value of each token as one number."""
    return F.zip_with(key_ids, value_ids, lambda k, v: F.shiftleft(k.cast("bigint"), 32) + v.cast("bigint"))


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``(a, b, n)``: how often word ``b`` stands beside word ``a`` at another place of one event.

    Pairs are made inside the event row, whose tokens are capped, and combined before the shuffle. An
    event with fewer than two tokens gives none.
    """
    w = F.col("w")
    beside = F.transform(w, lambda a, i: F.transform(F.filter(w, lambda _, j: i != j), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    rows = encoded.select(words(F.col("key_ids"), F.col("value_ids")).alias("w"))
    return rows.select(F.explode(F.flatten(beside)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def mutual_information(pairs: DataFrame) -> DataFrame:
    """``(a, b, m)``: the log of how much more often the pair occurs than by chance, where above zero."""
    margin = pairs.groupBy("a").agg(F.sum("n").alias("n_a"))
    total = margin.agg(F.sum("n_a")).first()[0] or 0
    both = pairs.join(margin, "a").join(margin.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), "b")
    m = F.log(F.col("n").cast("double") * F.lit(float(total)) / F.col("n_a") / F.col("n_b"))
    return both.select("a", "b", m.alias("m")).where("m > 0")


def _times(matrix: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """The matrix times the vectors: ``(word, q)``."""
    sums = [F.sum(F.rint(F.col("m") * F.col("q")[i]).cast("bigint")) for i in range(size)]
    found = matrix.join(vectors, F.col("b") == F.col("word")).groupBy("a").agg(F.array(*sums).alias("q"))
    return found.withColumnRenamed("a", "word")


def _gram(vectors: DataFrame, size: int) -> np.ndarray:
    """Products of all pairs of columns as whole numbers, summed exactly per task and then by Spark."""
    top = vectors.agg(F.max(F.array_max(F.transform("q", F.abs)))).first()[0] or 1
    unit = 2.0 ** np.ceil(np.log2(top))  # brings every number into [-1, 1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (size * size)
        for batch in batches:
            q = batch.column("q").flatten().to_numpy().reshape(-1, size) / unit
            for at in range(0, len(q), _ROWS):
                part = q[at : at + _ROWS]
                whole = np.rint(part[:, :, None] * part[:, None, :] * _PRODUCT).astype(np.int64).sum(axis=0)
                total = [a + b for a, b in zip(total, whole.ravel().tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size * size), pa.int32()), pa.array([str(v) for v in total], pa.string())], ["place", "v"]
        )

    parts = vectors.select("q").mapInArrow(products, "place int, v string")
    sums = parts.groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("place").collect()
    values = np.array([float(int(r["v"])) for r in sums] or [0.0] * (size * size))
    return values.reshape(size, size) * ((unit / UNIT) ** 2 / _PRODUCT)


def _turned(vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    size = len(turn)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q").flatten().to_numpy().reshape(-1, size) / UNIT
            out = np.zeros_like(q)
            for k in range(size):  # one product after the other: a row does not depend on its batch
                out += q[:, k : k + 1] * turn[k]
            flat = pa.array(np.rint(out * UNIT).astype(np.int64).ravel())
            ends = pa.array(np.arange(0, len(flat) + 1, size), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.ListArray.from_arrays(ends, flat)], ["word", "q"])

    return vectors.mapInArrow(apply, "word bigint, q array<bigint>")


def word_vectors(pairs: DataFrame, size: int = 16, seed: int = 0) -> DataFrame:
    """``(word, q)``: the leading directions of the mutual information, each scaled by the root of its
    strength, in units of 2^-30. Directions that do not exist are zero; a word without any pair
    above chance has no row. No pairs give no rows."""
    matrix = materialize(mutual_information(materialize(pairs, "token-pairs")), "token-information")
    start = [F.pmod(F.xxhash64(F.col("word"), F.lit(i), F.lit(seed)), F.lit(2 * UNIT)) - UNIT for i in range(size)]
    vectors = matrix.select(F.col("a").alias("word")).distinct().withColumn("q", F.array(*start))
    for step in range(ROUNDS):
        product = materialize(_times(matrix, vectors, size), "token-directions")
        strength, turn = np.linalg.eigh(_gram(product, size))
        strength, turn = strength[::-1], turn[:, ::-1]
        turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
        real = strength > max(float(strength[0]), 0.0) * 1e-9
        power = -0.25 if step == ROUNDS - 1 else -0.5
        vectors = _turned(product, turn * np.where(real, np.where(real, strength, 1.0) ** power, 0.0))
    return materialize(vectors, "token-vectors")


def record_vectors(encoded: DataFrame, vectors: DataFrame, size: int = 16) -> DataFrame:
    """``(entity_id, usr, last_event, concat)``: the mean vector of a record's tokens and of its newest
    event that has tokens. A word without a vector counts as zero; a record without tokens has no row."""
    tokens = encoded.select("entity_id", "event_ord", F.explode(words(F.col("key_ids"), F.col("value_ids"))).alias("word"))
    small = vectors.count() * size <= BROADCAST_NUMBERS
    joined = tokens.join(F.broadcast(vectors) if small else vectors, "word", "left")
    each = [F.coalesce(F.sum(F.col("q")[i]), F.lit(0)) for i in range(size)]
    events = joined.groupBy("entity_id", "event_ord").agg(F.count(F.lit(1)).alias("n"), F.array(*each).alias("q"))

    def mean(q: Column, n: Column) -> Column:
        return F.transform(q, lambda v: v.cast("double") / n / UNIT)

    whole = [F.sum(F.col("q")[i]) for i in range(size)]
    records = events.groupBy("entity_id").agg(
        F.sum("n").alias("n"), F.array(*whole).alias("q"), F.max_by(F.struct("n", "q"), "event_ord").alias("last")
    )
    return records.select(
        "entity_id", mean(F.col("q"), F.col("n")).alias("usr"), mean(F.col("last.q"), F.col("last.n")).alias("last_event")
    ).withColumn("concat", F.concat("usr", "last_event"))

"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features of a Gaussian kernel are approximated by ``N_FOURIER`` cosines of random projections
(Rahimi and Recht). Each task adds up its part of the normal equations; the sums meet per matrix row
and only the finished matrix, of fixed size, comes to the driver. Held-back training rows calibrate
the raw scores by pool-adjacent-violators. Fitting reads the rows of at most ``MAX_LABELLED`` labelled ids (those
with the smallest hash), equal rows of an id once; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import lean
from eventlens.llm.textstats import COUNTS, counts_table, with_counts
from eventlens.session import materialize

MAX_LABELLED = 40_000
N_FOURIER = 256
RIDGE = 1e-4
CLIP = 4.0
FOLDS = 5
SEED = 11


@dataclass(frozen=True)
class Model:
    """``weights`` is None when there was nothing to learn from; then every score is ``prior``."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray
    prior: float

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return fourier(statistics, self.mean, self.scale, self.directions, self.phases) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(statistics), self.prior)
        return np.interp(self.raw(statistics), self.knots, self.values)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; fold 0 is held out. A null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def statistics(counts: np.ndarray) -> np.ndarray:
    """Scale-free statistics of texts from their ``COUNTS`` (rows x counts)."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}
    words, chars, letters = (np.maximum(x, 1) for x in (c["n_words"], c["word_chars"], c["n_upper"] + c["n_lower"]))
    lines = np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_edge_symbols"] / words,
        c["n_bars"] / words, c["n_marks"] / words, c["n_stops"] / words, c["n_upper"] / letters, c["n_digits"] / chars,
        c["n_other"] / chars, c["n_dup_lines"] / lines, np.log1p(c["n_words"] / lines), c["n_repeat_words"] / words,
        c["n_distinct_words"] / words * np.log1p(words), c["n_top_word"] / words,
    ])


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    waves = np.sqrt(2.0 / len(phases)) * np.cos(z @ directions + phases)
    return np.hstack([waves, np.ones((len(x), 1))])


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots at both ends of every pool, with the pool's share of label 1
    (half a row of each label added). Equal raw scores start in one pool."""
    points, place = np.unique(raw, return_inverse=True)
    ones, rows = np.bincount(place, weights=label), np.bincount(place)
    pools: list[tuple[float, float, float, float]] = []  # first and last raw score, ones, rows
    for x, y, n in zip(points.tolist(), ones.tolist(), rows.tolist()):
        pools.append((x, x, y, n))
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            (a, _, y1, n1), (_, d, y2, n2) = pools[-2:]
            pools[-2:] = [(a, d, y1 + y2, n1 + n2)]
    knots = np.array([x for a, b, _, _ in pools for x in (a, b)])
    values = np.array([(y + 0.5) / (n + 1.0) for _, _, y, n in pools for _ in range(2)])
    return knots, np.maximum.accumulate(values)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows outside fold 0. Null labels and unknown documents are not used."""
    key = F.col(f"`{id_col}`")
    chosen = (
        labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("id")) != 0))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(MAX_LABELLED)
    )
    # at most MAX_LABELLED ids and labels
    texts = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    # repeated rows count once
    rows = materialize(with_counts(texts.dropDuplicates(["id", "text"]), "text", ["id", "y"]), "quality-training")
    rng = np.random.default_rng(SEED)
    width = statistics(np.zeros((1, len(COUNTS)), dtype=np.int64)).shape[1]
    directions = rng.normal(size=(width, N_FOURIER)) / np.sqrt(width / 2.0)
    phases = rng.uniform(0, 2 * np.pi, N_FOURIER)
    schema = "part string, i int, v array<double>"

    def counts_of(batch: pd.DataFrame) -> np.ndarray:
        return batch[list(COUNTS)].to_numpy(dtype=np.int64)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s, y = statistics(counts_of(batch)), batch["k1"].to_numpy(float)
                v = [np.concatenate(([len(y), y.sum()], s.sum(axis=0), (s * s).sum(axis=0)))]
                yield pd.DataFrame({"part": ["moments"], "i": [0], "v": v})

    def added(rows: DataFrame) -> dict[int, np.ndarray]:
        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = np.sum(np.stack(group["v"].to_list()), axis=0)
            return pd.DataFrame({"part": [group["part"].iloc[0]], "i": [group["i"].iloc[0]], "v": [total]})

        return {r["i"]: np.array(r["v"]) for r in rows.groupBy("part", "i").applyInPandas(add, schema).collect()}

    first = added(rows.mapInPandas(moments, schema)).get(0)
    if first is None or first[1] in (0.0, first[0]):
        prior = 0.5 if first is None else float((first[1] + 0.5) / (first[0] + 1.0))
        none = np.zeros(width)
        return Model(none, none + 1, directions, phases, None, np.zeros(1), np.full(1, prior), prior)
    n, positives = first[0], first[1]
    mean = first[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(first[2 + width :] / n - mean * mean, 1e-8))
    calibrates = F.pmod(F.xxhash64("k0", F.lit(SEED + 1)), F.lit(4)) == 0

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((N_FOURIER + 1, N_FOURIER + 2))
        for batch in batches:
            if len(batch):
                z = fourier(statistics(counts_of(batch)), mean, scale, directions, phases)
                total += z.T @ np.hstack([z, batch["k1"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"part": "equations", "i": range(len(total)), "v": list(total)})

    solved = added(rows.where(~calibrates).mapInPandas(equations, schema))
    matrix = np.stack([solved[i] for i in range(N_FOURIER + 1)])
    left = matrix[:, :-1] + RIDGE * n * np.eye(N_FOURIER + 1)
    weights = np.linalg.solve(left, matrix[:, -1])
    held = rows.where(calibrates).toPandas()  # a quarter of the bounded sample
    if held.empty:
        held = rows.toPandas()
    model = Model(mean, scale, directions, phases, weights, np.zeros(1), np.zeros(1), float(positives / n))
    knots, values = isotonic(model.raw(statistics(counts_of(held))), held["k1"].to_numpy(float))
    return Model(mean, scale, directions, phases, weights, knots, values, model.prior)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Every row with its ``score`` (an input column of that name is replaced).

    A null text is scored as an empty one; equal texts have equal scores. Only the text plays a part.
    """
    kept = docs.drop("score")
    names = [f"c{i}" for i in range(len(kept.columns))]
    plain = kept.toDF(*names)
    text = F.coalesce(F.col(f"c{kept.columns.index(text_col)}").cast("string"), F.lit(""))
    carried = plain.withColumn("raw", text.cast("binary"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.score(statistics(counts_table(batch.column(batch.num_columns - 1)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*names, "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return carried.mapInArrow(lean(score), f"{fields}, score double").toDF(*kept.columns, "score")

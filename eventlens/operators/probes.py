"""Scoring features and vectors against labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators.cooccurrence import pair_counts, record_vectors, word_vectors
from eventlens.operators.logistic import MAX_WIDTH, LogisticModel, fit_logistic
from eventlens.operators.ordered import quantiles, running_totals
from eventlens.session import materialize

RESULT = "name string, auc double, n_train bigint, n_val bigint"
SAME_TOTAL = "decimal(38,0)"


def rank_auc(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, auc, n_pos, n_neg)``: the share of (positive, negative) pairs in the right order,
    ties counting half, from running counts over distinct scores. Null with one class only."""
    by = list(by)
    target = F.col(label).cast("boolean")
    counts = materialize(
        scored.groupBy(*by, score).agg(
            F.count_if(target).alias("pos"), F.count_if(~target).alias("neg")
        ),
        "score-counts",
    )
    cum = running_totals(counts, by, [score], {"neg_upto": F.col("neg")})
    twice = F.col("pos").cast(SAME_TOTAL) * (2 * F.col("neg_upto") - F.col("neg"))
    sums = cum.groupBy(*by).agg(
        F.sum(twice).alias("twice"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    return sums.select(
        *by,
        F.when(
            (F.col("n_pos") > 0) & (F.col("n_neg") > 0),
            F.col("twice").cast("double") / (F.lit(2.0) * F.col("n_pos") * F.col("n_neg")),
        ).alias("auc"),
        "n_pos", "n_neg",
    )


def with_partition(df: DataFrame, val_ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Add ``is_val``: whether the entity is in the validation ids. All others train."""
    marked = val_ids.select(key).distinct().withColumn("found", F.lit(True))
    return df.join(marked, key, "left").withColumn("is_val", F.coalesce("found", F.lit(False))).drop("found")


def partition_sizes(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~F.col("is_val")).alias("n_train"), F.count_if("is_val").alias("n_val"))


# -- preprocessing -----------------------------------------------------------------


def scaling_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, median, mean, std)``: exact medians of the training rows, then mean and
    population deviation with missing values at the median. One row per feature column."""
    slots = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    long = train.select(F.explode(slots).alias("s")).select("s.*")
    medians = quantiles(long, ["column"], "v", [0.5]).select("column", F.col("quantile").alias("median"))
    filled = long.join(F.broadcast(medians), "column").withColumn("v", F.coalesce("v", "median"))
    return filled.groupBy("column").agg(
        F.max("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )


def scaled(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Impute and standardise the numeric columns; a constant column becomes 0."""
    out = df
    for r in stats.collect():
        std = r["std"] or 1.0
        value = F.coalesce(F.col(r["column"]).cast("double"), F.lit(r["median"]))
        out = out.withColumn(r["column"], (value - F.lit(r["mean"])) / F.lit(std))
    return out


def category_encoder(columns: Sequence[str]) -> list:
    """Index and one-hot encode. Missing is a category of its own; a value not seen in
    training gives all zeros while every seen value keeps its slot."""
    index = StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_ix" for c in columns],
        handleInvalid="keep", stringOrderType="alphabetAsc",
    )
    hot = OneHotEncoder(
        inputCols=[f"{c}_ix" for c in columns], outputCols=[f"{c}_hot" for c in columns],
        dropLast=True,
    )
    return [index, hot]


def fill_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in columns})


def fold_rare(df: DataFrame, train: DataFrame, column: str, min_rows: int) -> DataFrame:
    """Values with fewer than ``min_rows`` training rows become ``rare``, so that at most
    rows / ``min_rows`` values are left."""
    common = fill_categories(train, [column]).groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    filled = fill_categories(df, [column])
    known = filled.join(common.where(F.col("__n") >= min_rows).drop("__n"), F.col(column) == F.col("__value"), "left")
    return known.withColumn(column, F.coalesce("__value", F.lit("rare"))).drop("__value")


def fit_categories(train: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """The indexer keeps its values on the driver: a column of very many values goes through
    ``fold_rare`` first, with a bound of the caller's choice."""
    return Pipeline(stages=category_encoder(columns)).fit(fill_categories(train, columns))


def hot_slots(df: DataFrame, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """``(entity_id, n_slots, n_set)`` of the one-hot part."""
    out = model.transform(fill_categories(df, columns))
    arrays = [vector_to_array(f"{c}_hot") for c in columns]
    flat = F.concat(*arrays)
    return out.select(
        "entity_id",
        F.size(flat).cast("bigint").alias("n_slots"),
        F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_set"),
    )


# -- models ------------------------------------------------------------------------


def _counts(df: DataFrame, label: str) -> tuple[int, int, int, int]:
    target = F.col(label).cast("int")
    r = df.agg(
        F.count_if(~F.col("is_val")).alias("n_train"), F.count_if("is_val").alias("n_val"),
        F.countDistinct(F.when(~F.col("is_val"), target)).alias("c_train"),
        F.countDistinct(F.when(F.col("is_val"), target)).alias("c_val"),
    ).first()
    return r["n_train"], r["n_val"], r["c_train"], r["c_val"]


def _result(df: DataFrame, name: str, auc: float | None, n_train: int, n_val: int) -> DataFrame:
    return df.sparkSession.createDataFrame([(name, auc, n_train, n_val)], RESULT)


def _width(assembled: DataFrame) -> int:
    first = assembled.select(F.size(vector_to_array("x")).alias("n")).first()
    return first["n"]


def _logistic(n_train: int) -> LogisticRegression:
    """For vectors too wide for Newton steps. L2 strength 1 on the summed loss, which is 1/n on
    Spark's mean loss."""
    return LogisticRegression(
        featuresCol="x", labelCol="y", maxIter=1000, regParam=1.0 / n_train,
        elasticNetParam=0.0, standardization=False,
    )


def _fit_and_score(df: DataFrame, name: str, model, n_train: int, n_val: int) -> DataFrame:
    fitted = model.fit(df.where(~F.col("is_val")))
    scored = fitted.transform(df.where("is_val")).select(
        vector_to_array("probability")[1].alias("score"), "y"
    )
    auc = rank_auc(scored, "score", "y").first()["auc"]
    return _result(df, name, auc, n_train, n_val)


def _newton(rows: DataFrame, x: str, *, standardize: bool) -> tuple[LogisticModel, float | None]:
    """The model of the training rows and its AUC on the others; ``rows`` has ``is_val`` and ``y``."""
    model = fit_logistic(rows.where(~F.col("is_val")), x, "y", standardize=standardize)
    scored = rows.where("is_val").select(model.score(F.col(x)).alias("score"), "y")
    return model, rank_auc(scored, "score", "y").first()["auc"]


def fitted_probe(vectors: DataFrame, vector: str, label: str) -> tuple[LogisticModel, float | None]:
    """A logistic model on scaled training vectors and its AUC on the validation rows. Both classes
    must occur in training."""
    rows = vectors.select(F.col(vector).alias("v"), F.col(label).cast("double").alias("y"), "is_val")
    return _newton(materialize(rows, "probe-rows"), "v", standardize=True)


def linear_probe(vectors: DataFrame, vector: str, label: str, name: str = "probe") -> DataFrame:
    """Scale on the training rows, fit a logistic model, AUC on the validation rows.
    ``vectors`` needs ``is_val``, the label and an array column. One class in a part: no AUC."""
    n_train, n_val, c_train, c_val = _counts(vectors, label)
    auc = fitted_probe(vectors, vector, label)[1] if c_train == c_val == 2 else None
    return _result(vectors, name, auc, n_train, n_val)


def probe_variants(vectors: DataFrame, variants: Sequence[str], label: str) -> DataFrame:
    """The probe on several vector columns: a handful of models, one row each."""
    results = [linear_probe(vectors, v, label, f"probe_{v}") for v in variants]
    return reduce(DataFrame.unionByName, results)


def baselines(
    features: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str],
    *, models: Sequence[str] = ("logreg", "gbdt"), seed: int = 0,
) -> DataFrame:
    """Logistic regression and boosted trees on aggregate features."""
    n_train, n_val, c_train, c_val = _counts(features, label)
    names = [f"baseline_{m}" for m in models]
    if c_train < 2 or c_val < 2:
        return reduce(
            DataFrame.unionByName, [_result(features, n, None, n_train, n_val) for n in names]
        )
    data = materialize(
        features.select(F.col(label).cast("double").alias("y"), "is_val", *numeric, *categorical),
        "feature-rows",
    )
    train = data.where(~F.col("is_val"))
    ready = scaled(data, scaling_stats(train, numeric))
    ready = fill_categories(ready, categorical) if categorical else ready
    encoded = fit_categories(train, categorical).transform(ready) if categorical else ready
    x = VectorAssembler(
        inputCols=[*numeric, *[f"{c}_hot" for c in categorical]], outputCol="all_features"
    ).transform(encoded).select(F.col("all_features").alias("x"), "y", "is_val")
    results = []
    for m in models:
        if m == "logreg" and _width(x) <= MAX_WIDTH:
            rows = x.select(vector_to_array("x").alias("x"), "y", "is_val")
            auc = _newton(rows, "x", standardize=False)[1]
            results.append(_result(x, f"baseline_{m}", auc, n_train, n_val))
        else:
            model = _logistic(n_train) if m == "logreg" else GBTClassifier(featuresCol="x", labelCol="y", seed=seed)
            results.append(_fit_and_score(x, f"baseline_{m}", model, n_train, n_val))
    return reduce(DataFrame.unionByName, results)


def comparison_report(results: DataFrame, checkpoint: str) -> DataFrame:
    """Kind from the name, best AUC first, results without an AUC last."""
    name = F.col("name")
    is_baseline = name.startswith("baseline_")
    return results.select(
        F.when(is_baseline, "n/a (baseline)").otherwise(checkpoint).alias("checkpoint"),
        F.when(name.startswith("probe_"), "probe").when(is_baseline, "baseline").otherwise("lora").alias("kind"),
        "name",
        F.when(~F.isnan("auc"), F.col("auc")).alias("auc"),
        "n_train", "n_val",
    ).orderBy(F.desc_nulls_last("auc"), "name")


# -- vectors -----------------------------------------------------------------------


def last_event_vectors(records: DataFrame, events: DataFrame, vector: Column, width: int) -> DataFrame:
    """Vector of the newest event per record, zeros for a record without events. The maximum is
    combined before the shuffle, whatever the size of the entity."""
    last = events.groupBy("entity_id").agg(
        F.max_by(vector, F.struct("created_at", "event_id")).alias("last_event")
    )
    zeros = F.array(*[F.lit(0.0)] * width)
    return records.join(last, "entity_id", "left").withColumn("last_event", F.coalesce("last_event", zeros))


def token_vectors(encoded: DataFrame, size: int = 16, seed: int = 0) -> DataFrame:
    """``(entity_id, usr, last_event, concat)`` from encoded events: a stand-in with the shape of record
    embeddings, so that probes have vectors to work on. The same for any partitioning."""
    vectors = word_vectors(pair_counts(encoded), size, seed)
    return record_vectors(encoded, vectors, size)


def stack(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the tables of several parts, each row tagged with its part."""
    return reduce(
        DataFrame.unionByName, [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    )

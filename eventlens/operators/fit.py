"""Learning the encoders from the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import registry as R
from eventlens.operators.bundle import N_SPECIAL, Bundle, EncoderConfig, category_sizes
from eventlens.operators.ordered import quantiles_of_counts, ranks
from eventlens.operators.split import SplitConfig, split_of, tree_fingerprint
from eventlens.operators.textvocab import learn_merges, word_counts
from eventlens.operators.validate import fields_long
from eventlens.session import materialize


def train_rows(df: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Rows of training entities. The split is a hash of the id, so this is a row filter."""
    return df.where(split_of(F.col("entity_id"), config) == "train")


def key_vocabulary(registry: R.Registry, spark: SparkSession) -> DataFrame:
    rows = [(k, N_SPECIAL + i) for i, k in enumerate(registry.token_keys())]
    return spark.createDataFrame(rows, "key string, key_id int")


def fit_values(
    events: DataFrame, profile: DataFrame | None, registry: R.Registry, config: EncoderConfig
) -> DataFrame:
    """Long ``(key, kind, num, txt)`` of the values the encoders may learn from."""
    kinds = [(f.key, f.kind) for f in registry.fields]

    def with_kind(long: DataFrame) -> DataFrame:
        kind = F.lit(None)
        for key, k in kinds:
            kind = F.when(F.col("key") == key, F.lit(k)).otherwise(kind)
        return long.select("key", kind.alias("kind"), "num", "txt").where(
            F.col("kind").isin(*R.TOKENIZABLE)
        )

    out = with_kind(fields_long(events, registry))
    if config.include_type:
        out = out.unionByName(
            with_kind(events.select(F.lit("type").alias("key"), F.lit(None).cast("double").alias("num"),
                                    F.col("type").alias("txt")))
        )
    if "profile" in config.fit_scopes and profile is not None:
        shaped = profile.select(
            "entity_id", F.lit("").alias("event_id"), F.lit(None).cast("timestamp").alias("created_at"),
            F.lit("").alias("type"), *[k for k in profile.columns if k in registry.profile_keys],
        )
        out = out.unionByName(with_kind(fields_long(shaped, registry)))
    return out


def distinct_values(values: DataFrame) -> DataFrame:
    """``(key, kind, num, txt, n)``: each distinct value once. The one shuffle of the fit;
    counts are combined before it, so a value that fills a third of the rows is one row."""
    return values.groupBy("key", "kind", "num", "txt").agg(F.count(F.lit(1)).alias("n"))


def numeric_bounds(counts: DataFrame, n_buckets: int, **kw) -> DataFrame:
    """Inner percentile edges per numeric key, zeros left out, equal edges once:
    ``(key, idx, bound)`` with idx from 0."""
    nonzero = counts.where((F.col("kind") == R.NUMERICAL) & (F.col("num") != 0.0)).select(
        "key", "num", "n"
    )
    edges = [i / n_buckets for i in range(1, n_buckets)]
    raw = quantiles_of_counts(nonzero, ["key"], "num", edges, **kw)
    arrays = raw.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("bounds")
    )
    return arrays.select("key", F.posexplode("bounds").alias("idx", "bound"))


def numeric_audit(events: DataFrame, registry: R.Registry) -> DataFrame:
    """Per numeric key: values, zeros and the share of rows of the key's families that
    carry no value."""
    slots = []
    for key in [k for k in registry.value_keys(events.columns) if registry.field(k).kind == R.NUMERICAL]:
        families = [f.name for f in registry.families if key in f.keys]
        slots.append(
            F.struct(
                F.lit(key).alias("key"),
                F.col("type").isin(families).alias("expected"),
                F.col(key).cast("double").alias("num"),
            )
        )
    return events.select(F.explode(F.array(*slots)).alias("s")).select("s.*").groupBy("key").agg(
        F.count("num").alias("n_values"),
        F.count_if(F.col("num") == 0.0).alias("n_zeros"),
        F.coalesce(
            F.count_if(F.col("num").isNull() & F.col("expected"))
            / F.nullif(F.count_if(F.col("expected") | F.col("num").isNotNull()), F.lit(0)),
            F.lit(0.0),
        ).alias("null_rate"),
    )


def category_vocabulary(
    counts: DataFrame, registry: R.Registry, base_id: int, **kw
) -> DataFrame:
    """``(key, value, value_id)``: a block per key in declaration order, values sorted."""
    order = F.lit(None)
    for i, key in enumerate(registry.keys_of(R.CATEGORICAL)):
        order = F.when(F.col("key") == key, F.lit(i)).otherwise(order)
    distinct = counts.where(F.col("kind") == R.CATEGORICAL).select(
        order.alias("key_ord"), "key", F.col("txt").alias("value")
    )
    ranked = ranks(distinct, [], ["key_ord", "value"], "rank", **kw)
    return ranked.select("key", "value", (F.lit(base_id - 1) + F.col("rank")).cast("int").alias("value_id"))


def fit(
    events: DataFrame,
    profile: DataFrame,
    registry: R.Registry,
    config: EncoderConfig = EncoderConfig(),
    split: SplitConfig = SplitConfig(),
) -> Bundle:
    """Fit all encoders on the training records (entities of that split with events)."""
    train = train_rows(events, split)
    ids = materialize(train_rows(events.select("entity_id").distinct(), split), "train-ids")  # one hash per entity
    n_train = ids.count()
    if n_train == 0:
        raise ValueError("no training record to fit on")
    train_profile = train_rows(profile, split)
    counts = materialize(
        distinct_values(fit_values(train, train_profile, registry, config)), "distinct-values"
    )
    bounds: dict[str, list[float]] = {k: [] for k in registry.keys_of(R.NUMERICAL)}
    for r in numeric_bounds(counts, config.n_numeric_buckets).orderBy("key", "idx").collect():
        bounds[r["key"]].append(r["bound"])
    empty = Bundle(registry, config, bounds, counts, 0)
    categories = materialize(
        category_vocabulary(counts, registry, empty.category_base), "categories"
    )
    merges: list[tuple[int, int, int]] = []
    if registry.keys_of(R.TEXT):
        texts = counts.where(F.col("kind") == R.TEXT)
        merges = learn_merges(word_counts(texts), config.bpe_vocab_size, config.bpe_min_frequency)
    sizes = category_sizes(categories)
    return Bundle(
        registry, config, bounds, categories, sum(n for n, _ in sizes.values()), merges, True,
        tree_fingerprint(ids).first()["fingerprint"], n_train, sizes,
    )

"""Aggregate features and labels per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.temporal import seconds_between
from eventlens.operators.ordered import heavy_groups, quantiles, ranks
from eventlens.operators.skew import join_per_entity
from eventlens.session import materialize

# Wide enough that an amount is summed as it is given; only results are rounded.
MONEY = "decimal(38,9)"
ESCALATION_MIN_EVENTS = 4


def amount_sums(events: DataFrame, amount: str = "amount") -> DataFrame:
    """Per entity: events, distinct types, sum and number of amounts. Amounts are summed as
    decimals, so the result does not depend on the order of rows."""
    return events.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("type").alias("n_types"),
        F.sum(F.col(amount).cast(MONEY)).alias("total"),
        F.count(amount).alias("n_amounts"),
    )


def aggregated_features(
    records: DataFrame, events: DataFrame, attributes: Sequence[str], milestones: Sequence[str]
) -> DataFrame:
    """One row per record. Events are reduced to one row per entity before they meet the
    records, so no large group crosses the join. An entity without events has zeros."""
    sums = amount_sums(events)
    joined = records.join(sums, "entity_id", "left")
    total = F.coalesce(F.col("total").cast("double"), F.lit(0.0))
    mean = F.when(F.col("n_amounts") > 0, F.col("total").cast("double") / F.col("n_amounts"))
    return joined.select(
        "entity_id",
        F.coalesce("n", F.lit(0)).alias("n_events"),
        F.coalesce("n_types", F.lit(0)).alias("n_distinct_event_types"),
        total.alias("total_amount"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_amount"),
        (seconds_between(F.col("signup_at"), F.col("evaluation_time")) / 86400.0).alias("days_since_signup"),
        *[F.col(m).isNotNull().alias(f"has_{m}") for m in milestones if m != "signup_at"],
        *attributes,
    )


def high_value_labels(events: DataFrame, profile: DataFrame) -> DataFrame:
    """Total above the median total of all profile entities, those without events included."""
    sums = events.groupBy("entity_id").agg(F.sum(F.col("amount").cast(MONEY)).alias("total"))
    totals = materialize(
        profile.select("entity_id").join(sums, "entity_id", "left").select(
            "entity_id", F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total")
        ),
        "entity-totals",
    )
    median = quantiles(totals, [], "total", [0.5]).first()
    threshold = median["quantile"] if median else None
    return totals.withColumn("is_high_value", F.col("total") > F.lit(threshold))


def escalating_labels(
    events: DataFrame, profile: DataFrame, heavy: Sequence[tuple] | None = None, **kw
) -> DataFrame:
    """More spent in the second half of the history than in the first, from four events up.

    The half of an event follows from its rank and the entity's event count; the sums of the
    halves are plain aggregates, combined before the shuffle.
    """
    slim = events.select("entity_id", "created_at", "event_id", F.col("amount").cast(MONEY).alias("amount"))
    if heavy is None:
        heavy = heavy_groups(slim, ["entity_id"], **kw)
    if heavy:
        ranked = ranks(slim, ["entity_id"], ["created_at", "event_id"], "rank", heavy=heavy, **kw)
        counts = events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
        placed = join_per_entity(ranked, counts, "inner", heavy)
    else:
        in_order = Window.partitionBy("entity_id").orderBy("created_at", "event_id")
        whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = slim.where(F.col("entity_id").isNotNull()).withColumns(
            {"rank": F.row_number().over(in_order), "n": F.count(F.lit(1)).over(whole)}
        )
    late = F.col("rank") > F.floor(F.col("n") / 2)
    halves = placed.groupBy("entity_id").agg(
        F.max("n").alias("n"),
        F.sum(F.when(late, F.col("amount"))).alias("second"),
        F.sum(F.when(~late, F.col("amount"))).alias("first"),
    )
    zero = F.lit(0).cast(MONEY)
    grows = (F.col("n") >= ESCALATION_MIN_EVENTS) & (
        F.coalesce("second", zero) > F.coalesce("first", zero)
    )
    return profile.select("entity_id").join(halves, "entity_id", "left").select(
        "entity_id", F.coalesce(grows, F.lit(False)).alias("is_escalating")
    )


def cohorts(events: DataFrame, profile: DataFrame, long_from: int = 3000) -> DataFrame:
    """Edge-case cohort per entity, read off the data."""
    shape = events.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi")
    )
    n = F.coalesce("n", F.lit(0))
    name = (
        F.when(n == 0, "zero_events").when(n == 1, "single_event")
        .when(n >= long_from, "long_history").when(F.col("lo") == F.col("hi"), "same_timestamp")
        .otherwise("normal")
    )
    return profile.select("entity_id").join(shape, "entity_id", "left").select(
        "entity_id", n.alias("n_events"), name.alias("cohort")
    )


def corpus_manifest(
    events: DataFrame, profile: DataFrame, cohort: DataFrame, labels: Mapping[str, DataFrame]
) -> DataFrame:
    """Long counts ``(section, item, n)``: entities, events, families, cohorts, labels."""
    def total(df: DataFrame, item: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("corpus").alias("section"), F.lit(item).alias("item"), "n"
        )

    def by(df: DataFrame, section: str, col: Column) -> DataFrame:
        return df.groupBy(col.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(section).alias("section"), "item", "n"
        )

    out = total(profile, "entities").unionByName(total(events, "events"))
    out = out.unionByName(by(events, "family", F.col("type")))
    out = out.unionByName(by(cohort, "cohort", F.col("cohort")))
    for name, df in labels.items():
        out = out.unionByName(by(df, name, F.when(F.col(name), "true").otherwise("false")))
    return out

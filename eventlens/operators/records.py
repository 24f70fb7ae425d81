"""Point-in-time records: what was known about an entity at its evaluation time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators.ordered import ranks, running_totals
from eventlens.operators.skew import join_per_entity
from eventlens.operators.split import SplitConfig, split_of


def distinct_points(points: DataFrame) -> DataFrame:
    """``(entity_id, evaluation_time)`` of every point. One given twice stops the job, as its record
    would be there twice; a point without an entity or a time is none."""
    named = points.where(F.col("entity_id").isNotNull() & F.col("evaluation_time").isNotNull())
    counted = named.groupBy("entity_id", "evaluation_time").agg(F.count(F.lit(1)).alias("n"))
    message = F.concat(
        F.lit("evaluation point given twice: "), F.col("entity_id"), F.lit(" at "), F.col("evaluation_time").cast("string")
    )
    return counted.select(
        "entity_id",
        F.when(F.col("n") > 1, F.raise_error(message)).otherwise(F.col("evaluation_time")).cast("timestamp").alias("evaluation_time"),
    )


def states_at(
    events: DataFrame, points: DataFrame, heavy: Sequence[tuple] | None = None, **kw
) -> DataFrame:
    """``(entity_id, evaluation_time, n_events, latest_at)``: what of the events is known at each point.

    An as-of merge: instants with their event counts and points lie in one sorted stream per entity,
    and a point takes the running state that it meets. Events are never joined with points, so
    the work is events plus points, however many points an entity has; an entity too large for one task
    is cut (see ``running_totals``). An event at the very instant of a point is known there.
    """
    instants = (
        events.where(F.col("created_at").isNotNull()).groupBy("entity_id", F.col("created_at").alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    marks = distinct_points(points).select("entity_id", F.col("evaluation_time").alias("at"))
    stream = instants.withColumn("is_point", F.lit(0)).unionByName(
        marks.withColumn("n", F.lit(0).cast("bigint")).withColumn("is_point", F.lit(1))
    )
    met = running_totals(
        stream, ["entity_id"], ["at", "is_point"], {"n_events": F.col("n")},
        maxima={"latest_at": F.when(F.col("is_point") == 0, F.col("at"))}, heavy=heavy, **kw,
    )
    return met.where(F.col("is_point") == 1).select("entity_id", F.col("at").alias("evaluation_time"), "n_events", "latest_at")


def evaluation_times(
    events: DataFrame, profile: DataFrame, points: DataFrame | None = None, heavy: Sequence[tuple] | None = None, **kw
) -> DataFrame:
    """``(entity_id, evaluation_time, n_events)`` of each record of each profile row.

    The default is one record, at the latest event, or at the signup for an entity without events.
    ``points(entity_id, evaluation_time)`` sets other times, as many per entity as are wanted, one
    record for each; an entity without a point keeps the default. Events meet the profile only after
    they are reduced to one row per entity or point.
    """
    base = profile.select("entity_id", "signup_at")
    if points is not None:
        met = states_at(events, points, heavy, **kw)
        placed = met.join(base, "entity_id", "left_semi").select("entity_id", "evaluation_time", "n_events")
        given = points.where(F.col("evaluation_time").isNotNull()).select("entity_id").distinct()
        others = profile.join(given, "entity_id", "left_anti")
        return placed.unionByName(evaluation_times(events, others))
    per_entity = events.groupBy("entity_id").agg(
        F.max("created_at").alias("latest"), F.count(F.lit(1)).alias("n")
    )
    return base.join(per_entity, "entity_id", "left").select(
        "entity_id",
        F.coalesce("latest", "signup_at").alias("evaluation_time"),
        F.coalesce("n", F.lit(0)).alias("n_events"),
    )


def restrict_to_profile(
    events: DataFrame, profile: DataFrame, heavy: Sequence[tuple] = ()
) -> DataFrame:
    """Events of entities that have a profile row; the others never reach a record."""
    return join_per_entity(events, profile.select("entity_id"), "left_semi", heavy)


def events_as_of(
    events: DataFrame, points: DataFrame | None = None, heavy: Sequence[tuple] = ()
) -> DataFrame:
    """Events with ``created_at <= evaluation_time``, each one once: of several points of an entity
    the last one counts.

    Without points the evaluation time is the entity's latest event, so every event passes
    and no join is made.
    """
    if points is None:
        return events
    times = points.groupBy("entity_id").agg(F.max("evaluation_time").alias("as_of"))
    joined = join_per_entity(events, times, "left", heavy)
    return joined.where("as_of is null or created_at <= as_of").drop("as_of")


def record_events(
    events: DataFrame, points: DataFrame, max_events: int, heavy: Sequence[tuple] | None = None, **kw
) -> DataFrame:
    """The history of every record: the newest ``max_events`` events known at each point, with
    ``evaluation_time``, ``event_ord`` (0 is the oldest kept) and ``latest_at``.

    A point that knows c events holds the places c - ``max_events`` + 1 to c of its entity's order.
    Places are cut into runs of ``max_events``, so a record lies in two runs at most and events meet
    points by (entity, run): no key holds more than a run of events, and rows that are not part of a
    history are met at most once for each that is. Events without a time are in no history.
    """
    if max_events < 1:
        raise ValueError("max_events must be at least 1")
    timed = events.where(F.col("created_at").isNotNull())
    placed = ranks(timed, ["entity_id"], ["created_at", "event_id"], "place", heavy=heavy, **kw)
    in_runs = placed.withColumn("run", F.floor((F.col("place") - 1) / max_events))
    skipped = F.greatest(F.col("n_events") - max_events, F.lit(0).cast("bigint"))
    known = states_at(events, points, heavy, **kw).where(F.col("n_events") > 0).withColumn("skipped", skipped)
    runs = F.sequence(F.floor(F.col("skipped") / max_events), F.floor((F.col("n_events") - 1) / max_events))
    spans = known.select("*", F.explode(runs).alias("run"))
    met = in_runs.join(spans, ["entity_id", "run"])
    return (
        met.where((F.col("place") > F.col("skipped")) & (F.col("place") <= F.col("n_events")))
        .withColumn("event_ord", F.col("place") - F.col("skipped") - 1)
        .select(*events.columns, "evaluation_time", "event_ord", "latest_at")
    )


def order_events(events: DataFrame, heavy: Sequence[tuple] | None = None, **kw) -> DataFrame:
    """Add ``event_ord`` (from 0) by ``(created_at, event_id)`` inside each entity."""
    ranked = ranks(events, ["entity_id"], ["created_at", "event_id"], "rank", heavy=heavy, **kw)
    return ranked.withColumn("event_ord", F.col("rank") - 1).drop("rank")


def clipped(milestone: Column, as_of: Column) -> Column:
    """A milestone after the evaluation time is not known yet."""
    return F.when(milestone <= as_of, milestone)


def build_records(
    events: DataFrame,
    profile: DataFrame,
    milestones: Sequence[str],
    *,
    config: SplitConfig = SplitConfig(),
    points: DataFrame | None = None,
    heavy: Sequence[tuple] | None = None,
) -> DataFrame:
    """One record per profile row, or per evaluation point where such are given: time, split, event
    count, attributes as they are, and milestones clipped to the evaluation time. All records of an
    entity are in one split."""
    times = evaluation_times(events, profile, points, heavy)
    joined = profile.join(times, "entity_id")
    return joined.select(
        "entity_id",
        split_of(F.col("entity_id"), config).alias("split"),
        "evaluation_time",
        "n_events",
        *[c for c in profile.columns if c != "entity_id" and c not in milestones],
        *[clipped(F.col(m), F.col("evaluation_time")).alias(m) for m in milestones],
    )


def lifelong_events(milestones: Sequence[str]) -> Column:
    """Ordered (key, instant) pairs; an absent milestone keeps its place with null."""
    return F.array(
        *[F.struct(F.lit(m).alias("key"), F.col(m).alias("at")) for m in milestones]
    )


def with_events(records: DataFrame) -> DataFrame:
    """Drop records without events. The count is already on the record: no join."""
    return records.where("n_events > 0")


def dropped_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(
        F.count_if(F.col("n_events") > 0).alias("n_kept"),
        F.count_if(F.col("n_events") == 0).alias("n_dropped"),
    )


def history_audit(histories: DataFrame, max_events: int) -> DataFrame:
    """One row over ``record_events``: events after their record's time, histories over the cap, and
    events of which a record holds an older one but not the next. All must be 0."""
    per_record = histories.groupBy("entity_id", "evaluation_time").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_ord").alias("last"),
        F.count_if(F.col("created_at") > F.col("evaluation_time")).alias("late"),
    )
    return per_record.agg(
        F.coalesce(F.sum("late"), F.lit(0)).alias("n_late_events"),
        F.count_if(F.col("n") > max_events).alias("n_over_cap"),
        F.count_if(F.col("n") != F.col("last") + 1).alias("n_with_gaps"),
        F.count(F.lit(1)).alias("n_histories"),
    )


def leakage_audit(
    records: DataFrame, events: DataFrame, milestones: Sequence[str], heavy: Sequence[tuple] = ()
) -> DataFrame:
    """One row: events after the evaluation time, future milestones. Both must be 0."""
    times = records.select("entity_id", "evaluation_time")
    late = (
        join_per_entity(events.select("entity_id", "created_at"), times, "inner", heavy)
        .agg(F.count_if(F.col("created_at") > F.col("evaluation_time")).alias("n_late_events"))
    )
    future = records.agg(
        F.coalesce(
            F.sum(sum((F.coalesce(F.col(m) > F.col("evaluation_time"), F.lit(False)).cast("int")
                       for m in milestones), F.lit(0))), F.lit(0)
        ).alias("n_future_milestones"),
        F.count(F.lit(1)).alias("n_records"),
    )
    stacked = late.unionByName(future, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def only_entities_in(df: DataFrame, other: DataFrame, key: str = "entity_id") -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def attach_labels(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Join one label per entity; an entity without one stops the job."""
    found = df.join(labels.select("entity_id", F.col(label).alias("found")), "entity_id", "left")
    message = F.concat(F.lit("no label for entity "), F.col("entity_id"))
    return found.withColumn(
        label, F.when(F.col("found").isNull(), F.raise_error(message)).otherwise(F.col("found"))
    ).drop("found")

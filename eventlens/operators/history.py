"""The capped history every later window relies on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.ordered import first_rows
from eventlens.operators.skew import split_heavy

PLACES = ("age_rank", "n_history", "latest_at")


def keep_recent(
    events: DataFrame, max_events: int, heavy: Sequence[tuple] | None = None, **kw
) -> DataFrame:
    """The newest ``max_events`` per entity, with ``event_ord`` (0 is the oldest kept) and
    ``latest_at``.

    The rank handles entities of any size (see ``first_rows``). What passes is at most
    ``max_events`` rows per entity, so the second window is bounded by the cap.
    """
    if max_events < 1:
        raise ValueError("max_events must be at least 1")
    newest = first_rows(
        events, ["entity_id"], ["created_at", "event_id"], max_events, "age_rank",
        newest_first=True, heavy=heavy, **kw,
    )
    per_entity = Window.partitionBy("entity_id")
    return (
        newest.withColumn("latest_at", F.max("created_at").over(per_entity))
        .withColumn("event_ord", F.count(F.lit(1)).over(per_entity) - F.col("age_rank"))
        .drop("age_rank")
    )


def placed_history(events: DataFrame, heavy: Sequence[tuple]) -> DataFrame:
    """All events with their place in the entity: ``age_rank`` (1 is the newest), ``n_history`` and
    ``latest_at``. Rows of heavy entities have no place here (see ``newest_placed``)."""
    hot, cold = split_heavy(events, ["entity_id"], heavy) if heavy else (None, events)
    per_entity = Window.partitionBy("entity_id")
    newest_first = per_entity.orderBy(F.desc("created_at"), F.desc("event_id"))
    whole = newest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one pass with the rank
    placed = cold.withColumns(
        {
            "age_rank": F.row_number().over(newest_first).cast("bigint"),
            "n_history": F.count(F.lit(1)).over(whole),
            "latest_at": F.max("created_at").over(whole),
        }
    )
    return placed if hot is None else placed.unionByName(hot, allowMissingColumns=True)


def newest_placed(placed: DataFrame, max_events: int, heavy: Sequence[tuple], **kw) -> DataFrame:
    """``keep_recent`` out of ``placed_history``: a row filter, but for the heavy entities."""
    if max_events < 1:
        raise ValueError("max_events must be at least 1")
    kept = (
        placed.where(F.col("age_rank") <= max_events)
        .withColumn("event_ord", F.least("n_history", F.lit(max_events)) - F.col("age_rank"))
        .drop("age_rank", "n_history")
    )
    if not heavy:
        return kept
    hot = placed.where(F.col("age_rank").isNull()).drop(*PLACES)
    return kept.unionByName(keep_recent(hot, max_events, heavy, **kw))

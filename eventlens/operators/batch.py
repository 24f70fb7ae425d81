"""Size-balanced batches and their packed form."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.hashing import digest
from eventlens.functions.temporal import CALENDAR
from eventlens.operators.mask import NO_LABEL
from eventlens.operators.ordered import part_of, ranks, running_totals, value_at_ranks
from eventlens.session import materialize

RECORDS_PER_RUN = 200_000
FAN = 64
MAPS = "id bigint, leaves array<bigint>, counts array<bigint>"


@dataclass(frozen=True)
class Budget:
    # Default budgets of one batch.
    max_event_tokens: int = 4096
    max_events: int = 2048
    max_records: int = 256
    n_length_buckets: int = 8
    seed: int = 0


def length_buckets(sizes: DataFrame, n_buckets: int) -> DataFrame:
    """Add ``bucket``: equal-count groups by (event tokens, entity). The bucket starts are
    found by rank; each record is then placed by comparing it with those few tuples."""
    n = sizes.count()
    per_bucket = math.ceil(n / max(1, min(n_buckets, n)))
    starts = list(range(1 + per_bucket, n + 1, per_bucket)) if n else []
    order = ["n_event_tokens", "entity_id"]
    cuts = value_at_ranks(sizes, order, starts) if starts else []
    return sizes.withColumn("bucket", part_of(order, cuts))


def bucket_order(n_buckets: int, seed: int, epoch: int) -> list[int]:
    """Buckets in the shuffled order of the epoch."""
    def key(b: int) -> str:
        return hashlib.sha256(f"{seed}|{epoch}|bucket|{b}".encode()).hexdigest()

    return sorted(range(n_buckets), key=key)


def shuffled(sizes: DataFrame, budget: Budget, epoch: int) -> DataFrame:
    """Add ``bucket``, ``bucket_pos`` and ``draw``; (bucket_pos, draw, entity_id) is the order
    of the epoch."""
    bucketed = length_buckets(sizes, budget.n_length_buckets)
    place = F.lit(0)
    for pos, b in enumerate(bucket_order(budget.n_length_buckets, budget.seed, epoch)):
        place = F.when(F.col("bucket") == b, pos).otherwise(place)
    return bucketed.withColumns(
        {
            "bucket_pos": place,
            "draw": digest(budget.seed, epoch, "record", F.col("entity_id")),
        }
    )


def _next_starts(tokens: np.ndarray, events: np.ndarray, budget: Budget) -> np.ndarray:
    """For a batch that starts at a record, where the next one starts: prefix sums and a search
    per budget; the nearest of the three limits decides, and a batch has one record at least."""
    at = np.arange(len(tokens))
    end = np.minimum(at + budget.max_records, len(tokens))
    for values, limit in ((tokens, budget.max_event_tokens), (events, budget.max_events)):
        total = np.concatenate(([0], np.cumsum(values)))
        end = np.minimum(end, np.searchsorted(total, total[:-1] + limit, side="right") - 1)
    return np.maximum(end, at + 1)


def _through(starts: np.ndarray, length: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place a run's first batch may start at: where the first batch after the run starts
    (counted from the run's end) and how many batches start inside."""
    leaves, count = np.arange(max(length, entries)) - length, np.zeros(max(length, entries), dtype=np.int64)
    for i in range(length - 1, -1, -1):
        nxt = starts[i]
        leaves[i], count[i] = (nxt - length, 1) if nxt >= length else (leaves[nxt], count[nxt] + 1)
    return leaves[:entries], count[:entries]


def _entered(runs: DataFrame, n_runs: int, entries: int) -> DataFrame:
    """``(id, entry, first)``: where the first batch of each run starts and its number.

    ``runs`` holds ``(id, leaves, counts)`` as maps from entry to exit. Maps are put together
    ``FAN`` at a time until few are left, and the entries then handed down the same levels, so the
    chain of batches through all runs is never one task.
    """
    def composed(group: pd.DataFrame) -> pd.DataFrame:
        place, total = np.arange(entries), np.zeros(entries, dtype=np.int64)
        for row in group.sort_values("id").itertuples():
            total, place = total + np.asarray(row.counts)[place], np.asarray(row.leaves)[place]
        return pd.DataFrame({"id": [group["id"].iloc[0] // FAN], "leaves": [place], "counts": [total]})

    def handed_down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        entry, first, out = int(group["entry"].iloc[0]), int(group["first"].iloc[0]), []
        for row in group.itertuples():
            out.append((row.id, entry, first))
            first, entry = first + int(row.counts[entry]), int(row.leaves[entry])
        return pd.DataFrame(out, columns=["id", "entry", "first"])

    levels = [runs]
    while n_runs > 1:
        up = levels[-1].groupBy(F.floor(F.col("id") / FAN)).applyInPandas(composed, MAPS)
        levels.append(materialize(up, "run-maps"))
        n_runs = -(-n_runs // FAN)
    spark = runs.sparkSession
    entered = spark.createDataFrame([(0, 0, 0)], "id bigint, entry bigint, first bigint")
    for level in reversed(levels[:-1] if len(levels) > 1 else levels):
        above = entered.withColumnRenamed("id", "__up")
        children = level.withColumn("__up", F.floor(F.col("id") / FAN)).join(above, "__up")
        down = children.groupBy("__up").applyInPandas(handed_down, "id bigint, entry bigint, first bigint")
        entered = materialize(down, "run-entries")
    return entered


def plan_batches(
    sizes: DataFrame,
    budget: Budget = Budget(),
    epoch: int = 0,
    *,
    records_per_run: int = RECORDS_PER_RUN,
) -> DataFrame:
    """Greedy batches: ``(entity_id, n_events, n_event_tokens, bucket, batch_id, pos)``.

    Records are packed along the epoch's order, over bucket borders too: a record opens a new batch
    when it would break a budget. That is one chain through all records, but where a batch ends only
    depends on where it starts. The order is cut into runs; each run works out, for every place its
    first batch may start at, where it is left (it also sees the records of one batch beyond its
    end), the runs' maps are put together, and then every run knows its first start. The result is
    the same for any ``records_per_run``; only the sizes travel.
    """
    entries = budget.max_records
    run_length = max(records_per_run, entries)
    sizes = materialize(
        sizes.select("entity_id", F.col("n_events").cast("bigint"), F.col("n_event_tokens").cast("bigint")), "record-sizes"
    )
    order = ["bucket_pos", "draw", "entity_id"]
    ranked = ranks(shuffled(sizes, budget, epoch), [], order, "place")
    placed = materialize(ranked.withColumn("place", F.col("place") - 1).drop("draw", "bucket_pos"), "epoch-order")
    n_runs = -(-placed.count() // run_length)
    here = F.floor(F.col("place") / run_length)
    beyond = (F.col("place") % run_length < entries) & (here > 0)
    both = F.when(beyond, F.array(here, here - 1)).otherwise(F.array(here))
    in_runs = placed.withColumn("id", F.explode(both))

    def mapped(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("place")
        number = run["id"].iloc[0]
        length = int((run["place"] // run_length == number).sum())
        starts = _next_starts(run["n_event_tokens"].to_numpy(), run["n_events"].to_numpy(), budget)
        leaves, counts = _through(starts, length, entries)
        return pd.DataFrame({"id": [number], "leaves": [leaves], "counts": [counts]})

    slim = in_runs.select("id", "place", "n_events", "n_event_tokens")
    maps = materialize(slim.groupBy("id").applyInPandas(mapped, MAPS), "run-maps")
    entered = _entered(maps, n_runs, entries)

    def numbered(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("place")
        mine = (run["place"] // run_length == run["id"]).to_numpy()
        starts = _next_starts(run["n_event_tokens"].to_numpy(), run["n_events"].to_numpy(), budget)
        opens, at = np.zeros(len(run), dtype=np.int64), int(run["entry"].iloc[0])
        while at < mine.sum():
            opens[at] = 1
            at = int(starts[at])
        run = run.assign(batch_id=int(run["first"].iloc[0]) - 1 + np.cumsum(opens))
        return run[mine][["entity_id", "n_events", "n_event_tokens", "bucket", "place", "batch_id"]]

    out = in_runs.join(entered, "id").groupBy("id").applyInPandas(
        numbered, "entity_id string, n_events bigint, n_event_tokens bigint, bucket int, place bigint, batch_id bigint"
    )
    start = F.min("place").over(Window.partitionBy("batch_id"))
    return out.withColumn("pos", F.col("place") - start).drop("place")


def batch_sizes(plan: DataFrame) -> DataFrame:
    return plan.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum("n_events").alias("n_events"),
        F.sum("n_event_tokens").alias("n_event_tokens"),
    )


def batch_stats(plan: DataFrame) -> DataFrame:
    """One row over all batches."""
    return batch_sizes(plan).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"),
        F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"),
        F.coalesce(F.sum("n_event_tokens"), F.lit(0)).alias("n_event_tokens"),
        F.coalesce(F.avg("n_records"), F.lit(0.0)).alias("mean_records_per_batch"),
        F.coalesce(F.avg("n_event_tokens"), F.lit(0.0)).alias("mean_event_tokens_per_batch"),
    )


def rank_batches(plan: DataFrame, n_ranks: int) -> DataFrame:
    """``(rank, step, batch_id, padded)``: every rank gets the same number of batches; missing
    ones are taken again from the front, in a cycle."""
    if n_ranks < 1:
        raise ValueError("n_ranks must be at least 1")
    batches = plan.select("batch_id").distinct()
    n = batches.count()
    if n == 0:
        return batches.selectExpr("0 rank", "0 step", "batch_id", "false padded").limit(0)
    target = math.ceil(n / n_ranks) * n_ranks
    spark = plan.sparkSession
    slots = batches.select(F.col("batch_id").alias("slot")).unionByName(
        spark.range(n, target).select(F.col("id").alias("slot"))
    )
    return slots.select(
        (F.col("slot") % n_ranks).alias("rank"),
        F.floor(F.col("slot") / n_ranks).alias("step"),
        (F.col("slot") % n).alias("batch_id"),
        (F.col("slot") >= n).alias("padded"),
    )


def progress(plan: DataFrame) -> DataFrame:
    """Running counters after each batch, in batch order."""
    return running_totals(
        batch_sizes(plan), [], ["batch_id"],
        {
            "global_step": F.lit(1).cast("bigint"),
            "records_processed": F.col("n_records"),
            "events_processed": F.col("n_events"),
            "tokens_processed": F.col("n_event_tokens"),
        },
    )


# -- packed form -----------------------------------------------------------------


def flat_batches(
    plan: DataFrame, profiles: DataFrame, encoded: DataFrame, masked: DataFrame
) -> DataFrame:
    """One row per batch: flat token and event buffers with cumulative offsets.

    ``profiles`` are encoded records, ``encoded`` their event rows and ``masked`` the token
    rows. Everything is grouped by batch, and a batch is bounded by its budget. Where ``masked`` has ``batch_id``
    and ``rec`` already, events and not tokens were sent to their batch (see ``in_batches``).
    """
    place = plan.select("entity_id", "batch_id", "pos")
    by_record = (
        profiles.join(place, "entity_id")
        .groupBy("batch_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "pos", "entity_id", "n_kept", "profile_key_ids", "profile_value_ids",
                        "profile_within_field_pos", "profile_time_coords",
                        F.array_repeat("pos", F.size("profile_key_ids")).alias("to_record"),
                    )
                )
            ).alias("r")
        )
    )
    in_batch = Window.partitionBy("batch_id").orderBy("pos", "event_ord")
    upto = in_batch.rowsBetween(Window.unboundedPreceding, 0)
    by_event = (
        encoded.join(place, "entity_id")
        .withColumn("end", F.sum(F.size("value_ids")).over(upto))
        .groupBy("batch_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "pos", "event_ord", "end", "time_to_latest", F.array(*CALENDAR).alias("calendar")
                    )
                )
            ).alias("e")
        )
    )
    tokens = masked if "batch_id" in masked.columns else masked.join(place.withColumnRenamed("pos", "rec"), "entity_id")
    by_token = (
        tokens.groupBy("batch_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "rec", "event_ord", "tok_ord", "key_id", "input_id", "pos", "label", "origin"
                    )
                )
            ).alias("t")
        )
    )
    joined = by_record.join(by_event, "batch_id", "left").join(by_token, "batch_id", "left")
    zero = F.array(F.lit(0).cast("bigint"))

    def or_empty(col: Column, kind: str) -> Column:
        return F.coalesce(col, F.array().cast(kind))

    history = F.aggregate(
        F.col("r.n_kept"), zero,
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n.cast("bigint"))),
    )
    return joined.select(
        "batch_id",
        F.col("r.entity_id").alias("entity_ids"),
        F.size("r").cast("bigint").alias("n_records"),
        F.flatten("r.profile_key_ids").alias("profile_key_ids"),
        F.flatten("r.profile_value_ids").alias("profile_value_ids"),
        F.flatten("r.profile_within_field_pos").alias("profile_within_field_pos"),
        F.flatten("r.profile_time_coords").alias("profile_time_coords"),
        F.flatten("r.to_record").alias("profile_token_to_record"),
        or_empty(F.col("t.key_id"), "array<int>").alias("event_key_ids"),
        or_empty(F.col("t.input_id"), "array<int>").alias("event_value_ids"),
        or_empty(F.col("t.pos"), "array<int>").alias("event_within_field_pos"),
        or_empty(F.col("t.label"), "array<int>").alias("event_labels"),
        or_empty(F.col("t.origin"), "array<int>").alias("event_mask_origin"),
        F.concat(zero, or_empty(F.col("e.end"), "array<bigint>")).alias("event_offsets"),
        or_empty(F.col("e.pos"), "array<bigint>").alias("event_to_record"),
        or_empty(F.col("e.time_to_latest"), "array<double>").alias("event_time_to_latest"),
        or_empty(F.col("e.calendar"), "array<array<double>>").alias("event_calendar_features"),
        history.alias("history_offsets"),
    )


def _rising(name: str) -> Column:
    pairs = F.arrays_zip(
        F.slice(F.col(name), F.lit(1), F.greatest(F.size(name) - 1, F.lit(0))).alias("a"),
        F.slice(F.col(name), F.lit(2), F.greatest(F.size(name) - 1, F.lit(0))).alias("b"),
    )
    return F.forall(pairs, lambda p: p["a"] <= p["b"])


def batch_problems(flat: DataFrame) -> DataFrame:
    """Per batch the list of broken rules; an intact batch has an empty list."""
    n_events = F.size("event_to_record")
    n_tokens = F.size("event_key_ids")
    starts = F.slice("history_offsets", F.lit(1), F.greatest(F.size("history_offsets") - 1, F.lit(0)))
    groups = F.flatten(
        F.transform(
            starts,
            lambda h, i: F.array_repeat(
                i.cast("bigint"), (F.element_at("history_offsets", i + 2) - h).cast("int")
            ),
        )
    )
    rules = {
        "labels do not cover the tokens": F.size("event_labels") != n_tokens,
        "mask flags do not cover the tokens": F.size("event_mask_origin") != n_tokens,
        "history offsets do not cover the records": F.size("history_offsets") != F.col("n_records") + 1,
        "event offsets do not cover the events": F.size("event_offsets") != n_events + 1,
        "history offsets fall": ~_rising("history_offsets"),
        "event offsets fall": ~_rising("event_offsets"),
        "history offsets do not end at the events": F.try_element_at("history_offsets", F.lit(-1)) != n_events,
        "event offsets do not end at the tokens": F.try_element_at("event_offsets", F.lit(-1)) != n_tokens,
        "events are not grouped as the offsets say": (n_events > 0)
        & (F.when(_rising("history_offsets"), groups) != F.col("event_to_record")),
        "a profile token points past the records":
            F.coalesce(F.array_max("profile_token_to_record"), F.lit(-1)) >= F.col("n_records"),
        "profile tokens are not in record order": ~_rising("profile_token_to_record"),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return flat.select("batch_id", "n_records", broken.alias("problems"))


def require_valid(flat: DataFrame) -> DataFrame:
    """The batches themselves; a broken one stops the job with its problems."""
    problems = batch_problems(flat).select("batch_id", "problems")
    message = F.concat_ws("; ", "problems")
    return flat.join(problems, "batch_id").withColumn(
        "n_records",
        F.when(F.size("problems") > 0, F.raise_error(message)).otherwise(F.col("n_records")),
    ).drop("problems")


def group_offsets(items: DataFrame, by: str, group: str) -> DataFrame:
    """Group ids to offsets: ``(by, group, start, end)`` from one row per item. The running sum
    is over the groups of one ``by`` value (records of a batch)."""
    counts = items.groupBy(by, group).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    ended = counts.withColumn("end", F.sum("n").over(w))
    return ended.select(by, group, (F.col("end") - F.col("n")).alias("start"), "end")


def group_ids(offsets: DataFrame, by: str, group: str) -> DataFrame:
    """Offsets back to one row per item: ``(by, item, group)``."""
    return offsets.where("end > start").select(
        by, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("item"), group
    )


def unpacked_events(flat: DataFrame) -> DataFrame:
    """Events of the source records out of packed batches: ``(entity_id, event_ord, key_ids, value_ids,
    labels)``. The offsets of a batch already are those of its lists of events, so nothing is copied per event."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {n: batch.column(n)[i].values for n in batch.schema.names}
                records, offsets = one["event_to_record"].to_numpy(), one["event_offsets"].cast(pa.int32())
                labels, shown = one["event_labels"], one["event_value_ids"]
                values = pc.if_else(pc.not_equal(labels, NO_LABEL), labels, shown)
                ords = np.arange(len(records)) - one["history_offsets"].to_numpy()[records]
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (one["event_key_ids"], values, labels)]
                yield pa.RecordBatch.from_arrays(
                    [one["entity_ids"].take(pa.array(records)), pa.array(ords, pa.int64()), *lists],
                    ["entity_id", "event_ord", "key_ids", "value_ids", "labels"],
                )

    needed = ("entity_ids", "event_offsets", "history_offsets", "event_to_record", "event_key_ids", "event_value_ids", "event_labels")
    kinds = "entity_id string, event_ord bigint, key_ids array<int>, value_ids array<int>, labels array<int>"
    return flat.select(*needed).mapInArrow(unpack, kinds)


def unpack_batches(flat: DataFrame) -> DataFrame:
    """Event tokens of the source records out of packed batches:
    ``(entity_id, event_ord, tok_ord, key_id, value_id, label)``."""
    zipped = F.arrays_zip("key_ids", "value_ids", "labels")
    return unpacked_events(flat).select("entity_id", "event_ord", F.posexplode(zipped).alias("tok_ord", "t")).select(
        "entity_id", "event_ord", "tok_ord",
        F.col("t.key_ids").alias("key_id"), F.col("t.value_ids").alias("value_id"), F.col("t.labels").alias("label"),
    )


def token_differences(source: DataFrame, again: DataFrame) -> DataFrame:
    """One row: tokens of ``source``, those that ``again`` lacks, and those it has beyond them. Both hold
    ``(entity_id, event_ord, key_ids, value_ids)``; events that are equal on both sides cancel as a whole, and
    only the tokens of the others are compared one by one."""
    cols = ["entity_id", F.col("event_ord").cast("bigint").alias("event_ord"), "key_ids", "value_ids"]
    sides = source.select(*cols, F.lit(1).alias("d")).unionByName(again.select(*cols, F.lit(-1).alias("d")))
    per_event = sides.groupBy("entity_id", "event_ord", "key_ids", "value_ids").agg(
        F.sum("d").alias("d"), F.count_if(F.col("d") == 1).alias("n")
    )
    size = F.size("key_ids")
    differs = (F.col("d") != 0) & (size > 0)
    rows = per_event.select(
        F.when(differs, F.col("entity_id")).alias("entity_id"), F.when(differs, F.col("event_ord")).alias("event_ord"),
        F.when(differs, F.col("d")).otherwise(0).alias("d"), F.when(differs, F.col("n")).otherwise(F.col("n") * size).alias("n"),
        F.posexplode_outer(F.when(differs, F.arrays_zip("key_ids", "value_ids"))).alias("tok_ord", "t"),
    )
    per_token = rows.groupBy("entity_id", "event_ord", "tok_ord", "t").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return per_token.agg(
        F.sum("n").alias("n_tokens"),
        F.coalesce(F.sum(F.greatest(F.col("d"), F.lit(0))), F.lit(0)).alias("n_lost"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("n_added"),
    )


def padding_waste(lengths: DataFrame, by: Sequence[str], length: str, *, heads: int = 1, width: int = 1) -> DataFrame:
    """Elements with padding to the longest against packed ones, linear and squared."""
    n = F.col(length).cast("bigint")
    sums = lengths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum(n).alias("total_length"),
        F.max(n).alias("max_length"),
        F.sum(n * n).alias("square_sum"),
    )
    full = F.col("n_sequences") * F.col("max_length")
    out = sums.select(
        *by, "n_sequences", "total_length", "max_length",
        (full * heads * width).alias("padded_elements"),
        (F.col("total_length") * heads * width).alias("packed_elements"),
        (full * F.col("max_length") * heads).alias("padded_squares"),
        (F.col("square_sum") * heads).alias("packed_squares"),
    )
    return out.withColumns(
        {
            "linear_ratio": F.try_divide("padded_elements", "packed_elements"),
            "square_ratio": F.try_divide("padded_squares", "packed_squares"),
        }
    )


def in_batches(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Event rows with ``batch_id`` and ``rec``, those of a batch in one partition. Partitions are not
    coalesced by their bytes: each event becomes many token rows there."""
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = plan.select("entity_id", "batch_id", F.col("pos").alias("rec"))
    return events.join(place, "entity_id").repartition(partitions, "batch_id")


def shuffle_context(masked: DataFrame, plan: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Permute the inputs of positions without a target among themselves, inside each batch.

    Two orders of the same positions (by place, by hash) are matched by rank: both are lists of one
    batch, which its budget bounds. Without a plan, ``masked`` has ``batch_id`` and ``rec`` already: then
    events, not tokens, were sent to their batch (see ``in_batches``).
    """
    rows = masked
    if plan is not None:
        rows = masked.join(plan.select("entity_id", "batch_id", F.col("pos").alias("rec")), "entity_id")
    order = ["rec", "event_ord", "tok_ord"]
    others = [c for c in rows.columns if c not in ("batch_id", *order)]
    has_target = F.coalesce(F.col("label") != NO_LABEL, F.lit(True))
    draw = digest(seed, "shuffle", F.col("batch_id"), F.col("event_id"), F.col("tok_ord"))
    lists = rows.groupBy("batch_id").agg(
        # positions without a target come first
        F.sort_array(F.collect_list(F.struct(has_target.alias("has_target"), *order, *others))).alias("t"),
        F.sort_array(F.collect_list(F.when(~has_target, F.struct(draw.alias("draw"), F.col("input_id"))))).alias("drawn"),
    )
    given = F.col("drawn.input_id")
    pairs = lists.select("batch_id", F.explode(F.arrays_zip(F.col("t").alias("t"), given.alias("given"))).alias("p"))
    return pairs.select(
        "batch_id", *[F.col(f"p.t.{c}").alias(c) for c in (*order, *others)],
        F.when(F.col("p.t.has_target"), F.col("p.t.input_id")).otherwise(F.col("p.given")).alias("new_input_id"),
    )

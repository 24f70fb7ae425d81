"""Events and profiles to token ids.

All work on one event is row-local: every field becomes a few columns, and the tokens of
the event are arrays on its row. Nothing is unpivoted and regrouped, so encoding adds no
shuffle to the one that capped the history. Long token rows are an ``explode`` away.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import registry as R
from eventlens.functions.buckets import length_label, numeric_token
from eventlens.functions.temporal import CALENDAR, calendar, seconds_between, soft_log
from eventlens.functions.values import as_category
from eventlens.operators.bundle import MILESTONE_ABSENT, MILESTONE_PRESENT, UNK, Bundle, category_sizes
from eventlens.operators.ordered import heavy_groups
from eventlens.operators.skew import BROADCAST_ROWS, broadcast_if_small, join_per_entity
from eventlens.operators.textvocab import text_dictionary, text_ids

BROADCAST_BYTES = 32 << 20


def _none() -> Column:
    return F.array().cast("array<int>")


def category_ids(df: DataFrame, keys: Sequence[str], bundle: Bundle, **kw) -> DataFrame:
    """Add ``id_<key>`` per categorical key; a value outside the vocabulary is unknown.

    Each key decides for itself: a vocabulary that is small in rows and bytes is broadcast, and only
    a large one is joined by shuffle. There the values that fill more than one task are found first
    and go by a broadcast of just these; the others are shuffled, and rows without a value have a
    value of their own that meets nothing, so they spread evenly instead of landing in one task.
    """
    sizes = bundle.category_sizes or category_sizes(bundle.categories)
    row = "event_id" if "event_id" in df.columns else "entity_id"
    given = df
    for key in keys:
        vocab = bundle.categories.where(F.col("key") == key).select(
            F.col("value").alias(f"value_{key}"), F.col("value_id").alias(f"found_{key}")
        )
        n, n_bytes = sizes.get(key, (0, 0))
        if n <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
            df = df.join(F.broadcast(vocab), as_category(df, key) == F.col(f"value_{key}"), "left")
        else:
            own = F.coalesce(as_category(given, key), F.concat(F.lit("\x00"), F.col(row))).alias(f"value_{key}")
            heavy = heavy_groups(given.where(F.col(key).isNotNull()).select(own), [f"value_{key}"], **kw)
            df = join_per_entity(df.withColumn(f"value_{key}", own), vocab, "left", heavy, key=f"value_{key}")
        df = df.withColumn(
            f"id_{key}",
            F.when(F.col(key).isNotNull(), F.coalesce(F.col(f"found_{key}"), F.lit(UNK))),
        ).drop(f"value_{key}", f"found_{key}")
    return df


def spelled_texts(rows: DataFrame, bundle: Bundle) -> DataFrame | None:
    """The ids of every distinct text of ``rows``, small enough to be broadcast, or None: then, and
    where there is no text field, rows are spelled in place."""
    keys = [k for k in bundle.registry.keys_of(R.TEXT) if k in rows.columns]
    if not keys:
        return None
    return text_dictionary(rows, keys, bundle.merges, bundle.text_base, bundle.config.max_within_field_tokens)


def _field_ids(df: DataFrame, keys: Sequence[str], bundle: Bundle, texts: DataFrame | None = None) -> DataFrame:
    """Add ``ids_<key>``: the value ids of the field, null when the field is absent."""
    kinds = {k: bundle.registry.field(k).kind for k in keys}
    df = category_ids(df, [k for k in keys if kinds[k] == R.CATEGORICAL], bundle)
    cap = bundle.config.max_within_field_tokens
    for key in keys:
        if kinds[key] == R.NUMERICAL:
            one = numeric_token(
                F.col(key).cast("double"), bundle.numeric_bounds.get(key, []),
                bundle.numeric_base, bundle.config.n_numeric_buckets,
            )
            ids = F.when(F.col(key).isNotNull(), F.array(one))
        elif kinds[key] == R.CATEGORICAL:
            ids = F.when(F.col(key).isNotNull(), F.array(f"id_{key}"))
        else:
            if texts is None:
                df = df.withColumn(f"all_{key}", text_ids(F.col(key), bundle.merges, bundle.text_base, cap))
            else:
                known = F.broadcast(texts.select(F.col("txt").alias(f"txt_{key}"), F.col("ids").alias(f"all_{key}")))
                df = df.join(known, F.col(key).cast("string") == F.col(f"txt_{key}"), "left").drop(f"txt_{key}")
            full = F.col(f"all_{key}")
            ids = F.when(F.size(full) == 0, F.array(F.lit(UNK))).when(
                full.isNotNull(), F.slice(full, 1, cap)
            )
        df = df.withColumn(f"ids_{key}", ids)
    return df.drop(*[f"id_{k}" for k in keys], *[f"all_{k}" for k in keys])


def event_keys(events: DataFrame, bundle: Bundle) -> list[str]:
    keys = bundle.registry.value_keys(events.columns)
    keys = [k for k in keys if bundle.registry.field(k).kind in R.TOKENIZABLE]
    return ["type", *keys] if bundle.config.include_type else keys


def _flatten(
    keys: Sequence[str], bundle: Bundle, keep: dict[str, Column]
) -> dict[str, Column]:
    """Concatenate the kept fields into the flat arrays of the row. Only text has more than one
    token a field; the others need no sequences, which keeps the generated code small."""
    ids = bundle.key_ids
    many = {k for k in keys if k not in bundle.registry.milestone_keys and bundle.registry.field(k).kind == R.TEXT}

    def joined(one: Callable[[str], Column], several: Callable[[str, Column], Column]) -> Column:
        parts = [several(k, F.size(f"ids_{k}")) if k in many else one(k) for k in keys]
        return F.concat(*[F.when(keep[k], p).otherwise(_none()) for k, p in zip(keys, parts)])

    def same(k: str) -> Column:
        return F.col(f"ids_{k}")

    return {
        "key_ids": joined(lambda k: F.array(F.lit(ids[k])), lambda k, n: F.array_repeat(F.lit(ids[k]), n)),
        "value_ids": joined(same, lambda k, n: same(k)),
        "within_field_pos": joined(lambda k: F.array(F.lit(0)), lambda k, n: F.sequence(F.lit(0), n - 1)),
        "field_lengths": joined(lambda k: F.array(F.lit(1)), lambda k, n: F.array(n)),
    }


def encode_events(events: DataFrame, bundle: Bundle, texts: DataFrame | None = None) -> DataFrame:
    """Tokens and clock features for capped events (``keep_recent``), one row per event.

    ``texts`` (``spelled_texts`` of rows that hold these events) saves the spelling in place.

    An event over the token cap loses whole fields from the first one that does not fit;
    a running sum over the fields of the row finds it.
    """
    keys = event_keys(events, bundle)
    df = _field_ids(events, keys, bundle, texts)
    cap = bundle.config.max_event_tokens
    running: Column = F.lit(0)
    keep: dict[str, Column] = {}
    for k in keys:
        there = F.col(f"ids_{k}").isNotNull()
        size = F.size(f"ids_{k}") if bundle.registry.field(k).kind == R.TEXT else F.lit(1)
        running = running + F.when(there, size).otherwise(0)
        keep[k] = there & (running <= cap)
    flat = _flatten(keys, bundle, keep)
    clock = calendar(F.col("created_at"))
    return df.select(
        "entity_id", "event_id", "created_at", "event_ord",
        *[c.alias(name) for name, c in flat.items()],
        (running > cap).alias("truncated"),
        soft_log(seconds_between(F.col("created_at"), F.col("latest_at"))).alias("time_to_latest"),
        *[clock[name].alias(name) for name in CALENDAR],
    )


def encode_profile(records: DataFrame, bundle: Bundle) -> DataFrame:
    """Profile tokens per record: sorted keys, a presence token for each milestone, no token
    for an absent attribute. The cap counts fields."""
    reg = bundle.registry
    keys = sorted(
        k for k in reg.profile_keys
        if k in records.columns and (k in reg.milestone_keys or reg.field(k).kind in R.TOKENIZABLE)
    )
    attributes = [k for k in keys if k not in reg.milestone_keys]
    df = _field_ids(records, attributes, bundle)
    for k in keys:
        if k in reg.milestone_keys:
            df = df.withColumn(
                f"ids_{k}",
                F.array(F.when(F.col(k).isNotNull(), MILESTONE_PRESENT).otherwise(MILESTONE_ABSENT)),
            )
    running: Column = F.lit(0)
    keep: dict[str, Column] = {}
    times = []
    for k in keys:
        there = F.col(f"ids_{k}").isNotNull()
        running = running + there.cast("int")
        keep[k] = there & (running <= bundle.config.max_profile_tokens)
        coord = milestone_time(F.col(k), F.col("evaluation_time")) if k in reg.milestone_keys else F.lit(0.0)
        times.append(
            F.when(keep[k], F.array_repeat(coord, F.size(f"ids_{k}")))
            .otherwise(F.array().cast("array<double>"))
        )
    flat = _flatten(keys, bundle, keep)
    return df.select(
        "entity_id", "split", "evaluation_time", "n_events",
        *[c.alias(f"profile_{name}") for name, c in flat.items()],
        F.concat(*times).alias("profile_time_coords"),
    )


def milestone_time(milestone: Column, as_of: Column) -> Column:
    """Soft-log time since the milestone; 0 when it has not happened."""
    return F.when(milestone.isNull(), 0.0).otherwise(soft_log(seconds_between(milestone, as_of)))


def event_tokens(encoded: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per event token with ``tok_ord``, ``pos``, ``key_id``, ``value_id``."""
    zipped = F.arrays_zip("key_ids", "value_ids", "within_field_pos")
    return encoded.select(
        "entity_id", "event_id", "event_ord", *keep, F.posexplode(zipped).alias("tok_ord", "t")
    ).select(
        "entity_id", "event_id", "event_ord", *keep, "tok_ord",
        F.col("t.within_field_pos").alias("pos"),
        F.col("t.key_ids").alias("key_id"), F.col("t.value_ids").alias("value_id"),
    )


def profile_tokens(encoded: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(
        "profile_key_ids", "profile_value_ids", "profile_within_field_pos", "profile_time_coords"
    )
    return encoded.select("entity_id", "split", F.posexplode(zipped).alias("tok_ord", "t")).select(
        "entity_id", "split", "tok_ord",
        F.col("t.profile_within_field_pos").alias("pos"),
        F.col("t.profile_key_ids").alias("key_id"),
        F.col("t.profile_value_ids").alias("value_id"),
        F.col("t.profile_time_coords").alias("time_coord"),
    )


# The stored row: column -> type.
SHARD_TYPES = {
    "entity_id": "string",
    "split": "string",
    "profile_key_ids": "array<bigint>",
    "profile_value_ids": "array<bigint>",
    "profile_within_field_pos": "array<bigint>",
    "profile_field_lengths": "array<bigint>",
    "profile_time_coords": "array<double>",
    "n_events_total": "bigint",
    "n_events_kept": "bigint",
    "events_truncated": "boolean",
    "event_ids": "array<string>",
    "event_key_ids": "array<array<bigint>>",
    "event_value_ids": "array<array<bigint>>",
    "event_within_field_pos": "array<array<bigint>>",
    "event_field_lengths": "array<array<bigint>>",
    "event_time_to_latest": "array<double>",
    "event_calendar_features": "array<array<double>>",
    "event_truncated": "array<boolean>",
}


def assemble(encoded_profile: DataFrame, encoded_events: DataFrame) -> DataFrame:
    """One nested row per record. Events are grouped by entity after the cap, so a list never
    holds more than ``max_history_events``; the grouping reuses the cap's partitioning."""
    event = F.struct(
        "event_ord", "event_id", "key_ids", "value_ids", "within_field_pos", "field_lengths",
        "time_to_latest", F.array(*CALENDAR).alias("calendar"), "truncated",
    )
    grouped = encoded_events.groupBy("entity_id").agg(F.sort_array(F.collect_list(event)).alias("e"))
    joined = encoded_profile.join(grouped, "entity_id", "left")
    lists = {
        "event_ids": "event_id", "event_key_ids": "key_ids", "event_value_ids": "value_ids",
        "event_within_field_pos": "within_field_pos", "event_field_lengths": "field_lengths",
        "event_time_to_latest": "time_to_latest", "event_calendar_features": "calendar",
        "event_truncated": "truncated",
    }
    kept = F.when(F.col("e").isNull(), 0).otherwise(F.size("e"))
    made = {
        "n_events_total": F.col("n_events"),
        "n_events_kept": kept,
        "events_truncated": kept < F.col("n_events"),
        **{
            name: F.coalesce(F.col(f"e.{part}"), F.array().cast(SHARD_TYPES[name]))
            for name, part in lists.items()
        },
    }
    return joined.select(
        *[made.get(name, F.col(name)).cast(t).alias(name) for name, t in SHARD_TYPES.items()]
    )


def record_sizes(encoded_profile: DataFrame, encoded_events: DataFrame) -> DataFrame:
    """Events, event tokens and all tokens per record, from the flat form: no nesting."""
    per_entity = encoded_events.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.size("value_ids")).alias("tokens")
    )
    return encoded_profile.join(per_entity, "entity_id", "left").select(
        "entity_id", "split",
        F.col("n_events").alias("n_events_total"),
        F.coalesce("events", F.lit(0)).alias("n_events"),
        F.coalesce("tokens", F.lit(0)).alias("n_event_tokens"),
        (F.coalesce("tokens", F.lit(0)) + F.size("profile_value_ids")).alias("n_value_tokens"),
        length_label(F.coalesce("events", F.lit(0))).alias("length_bucket"),
    )


def field_groups(shards: DataFrame) -> DataFrame:
    """Rebuild the fields of each stored event from flat arrays and field lengths:
    ``(entity_id, event_ord, event_id, field_no, key_ids, value_ids, positions)``.

    The start of a field is the sum of the lengths before it, by a running fold over the
    (capped) lengths of one event.
    """
    events = shards.select(
        "entity_id",
        F.posexplode(
            F.arrays_zip(
                "event_ids", "event_key_ids", "event_value_ids", "event_within_field_pos",
                "event_field_lengths",
            )
        ).alias("event_ord", "e"),
    )
    lengths = F.col("e.event_field_lengths")
    spans = F.transform(
        lengths,
        lambda n, i: F.struct(
            (F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x) + 1)
            .cast("int").alias("start"),
            n.cast("int").alias("n"),
        ),
    )
    fields = events.select("entity_id", "event_ord", "e", F.posexplode(spans).alias("field_no", "s"))

    def part(name: str) -> Column:
        return F.slice(F.col(f"e.{name}"), F.col("s.start"), F.col("s.n"))

    return fields.select(
        "entity_id", "event_ord", F.col("e.event_ids").alias("event_id"), "field_no",
        part("event_key_ids").alias("key_ids"),
        part("event_value_ids").alias("value_ids"),
        part("event_within_field_pos").alias("positions"),
    )


def stored_tokens(shards: DataFrame) -> DataFrame:
    """Long event tokens out of nested rows."""
    events = shards.select(
        "entity_id", "split",
        F.posexplode(
            F.arrays_zip("event_ids", "event_key_ids", "event_value_ids", "event_within_field_pos")
        ).alias("event_ord", "e"),
    )
    return events.select(
        "entity_id", "split", F.col("e.event_ids").alias("event_id"), "event_ord",
        F.posexplode(
            F.arrays_zip(
                F.col("e.event_key_ids").alias("k"), F.col("e.event_value_ids").alias("v"),
                F.col("e.event_within_field_pos").alias("p"),
            )
        ).alias("tok_ord", "t"),
    ).select(
        "entity_id", "split", "event_id", "event_ord", "tok_ord",
        F.col("t.p").alias("pos"), F.col("t.k").alias("key_id"), F.col("t.v").alias("value_id"),
    )


def oov_rates(events: DataFrame, split: Column, bundle: Bundle) -> DataFrame:
    """Share of category values outside the vocabulary per key and split."""
    keys = [k for k in event_keys(events, bundle) if bundle.registry.field(k).kind == R.CATEGORICAL]
    found = category_ids(events.withColumn("split", split), keys, bundle)
    slots = [F.struct(F.lit(k).alias("key"), F.col(f"id_{k}").alias("value_id")) for k in keys]
    return (
        found.select("split", F.explode(F.array(*slots)).alias("s")).select("split", "s.*")
        .where("value_id is not null").groupBy("key", "split")
        .agg(
            F.count(F.lit(1)).alias("n_lookups"),
            F.count_if(F.col("value_id") == UNK).alias("n_unknown"),
            F.avg((F.col("value_id") == UNK).cast("double")).alias("oov_rate"),
        )
    )


def field_report(events: DataFrame, split: Column, bundle: Bundle, train: str = "train") -> DataFrame:
    """What was learned per event field, and how it holds outside of the training split: values and
    zeros that were fitted on, the numeric boundaries, and the share of the other splits' values that
    the vocabulary does not know (a text is unknown when it has no piece). Null where it does not apply."""
    keys = event_keys(events, bundle)
    kinds = {k: bundle.registry.field(k).kind for k in keys}
    found = category_ids(events.withColumn("split", split), [k for k in keys if kinds[k] == R.CATEGORICAL], bundle)

    def unknown(key: str) -> Column:
        if kinds[key] == R.NUMERICAL:
            return F.lit(None).cast("boolean")
        return F.col(f"id_{key}") == UNK if kinds[key] == R.CATEGORICAL else F.col(key).cast("string") == ""

    slots = [
        F.struct(
            F.lit(k).alias("key"), F.lit(kinds[k]).alias("kind"), F.col(k).isNotNull().alias("there"),
            (F.col(k).cast("double") == 0.0 if kinds[k] == R.NUMERICAL else F.lit(None).cast("boolean")).alias("zero"),
            unknown(k).alias("unknown"),
        )
        for k in keys
    ]
    fitted = F.col("split") == train
    fields = found.select("split", F.explode(F.array(*slots)).alias("s")).select("split", "s.*").where("there").groupBy("key", "kind").agg(
        F.count_if(fitted).alias("n_train_values"),
        F.sum(F.when(fitted, F.col("zero").cast("bigint"))).alias("n_zero_values"),
        F.avg(F.when(~fitted, F.col("unknown").cast("double"))).alias("oov_rate"),
    )
    bounds = [(k, len(b), min(b, default=None), max(b, default=None)) for k, b in bundle.numeric_bounds.items()]
    table = events.sparkSession.createDataFrame(bounds, "key string, n_bounds bigint, low_bound double, high_bound double")
    return fields.join(F.broadcast(table), "key", "left")  # one row per numeric field of the schema


def decode_keys(tokens: DataFrame, bundle: Bundle) -> DataFrame:
    """Add ``key``, ``kind`` and the readable ``value`` of each token."""
    names = {i: k for k, i in bundle.key_ids.items()}
    key: Column = F.lit(None).cast("string")
    kind: Column = F.lit(None).cast("string")
    for i, k in names.items():
        key = F.when(F.col("key_id") == i, F.lit(k)).otherwise(key)
        kind = F.when(F.col("key_id") == i, F.lit(bundle.registry.field(k).kind)).otherwise(kind)
    vocab = broadcast_if_small(
        bundle.categories.select("value_id", F.col("value").alias("word")), bundle.n_categories
    )
    base = bundle.numeric_base
    value = (
        F.when(F.col("value_id") == UNK, "[UNK]")
        .when(F.col("value_id") == MILESTONE_PRESENT, "[PRESENT]")
        .when(F.col("value_id") == MILESTONE_ABSENT, "[ABSENT]")
        .when(F.col("value_id") == base, "[ZERO]")
        .when(
            F.col("value_id") < bundle.category_base,
            F.concat(F.lit("[P"), (F.col("value_id") - base - 1).cast("string"), F.lit("]")),
        )
        .when(F.col("value_id") < bundle.text_base, F.col("word"))
        .otherwise(F.concat(F.lit("[T"), (F.col("value_id") - bundle.text_base).cast("string"), F.lit("]")))
    )
    return tokens.join(vocab, "value_id", "left").withColumns(
        {"key": key, "kind": kind, "value": value}
    ).drop("word")

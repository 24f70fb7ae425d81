"""Fitting encoders, encoding events and profiles, and the stored form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens import registry as R
from eventlens.functions.buckets import length_label, numeric_token
from eventlens.functions.temporal import CALENDAR, calendar, seconds_between, soft_log
from eventlens.operators import encode, fit
from eventlens.operators.bundle import N_SPECIAL, EncoderConfig
from eventlens.operators.history import PLACES
from eventlens.operators.split import split_of
from eventlens.operators.textvocab import byte_ids
from eventlens.operators.validate import fields_long
from eventlens.plans.catalog import query
from eventlens.plans.reference_sql import secs_sql, softlog_sql, split_sql, tree_sql
from eventlens.plans.workspace import Binding, Workspace
from eventlens.session import materialize, new_path
from eventlens.sources import bundles, shards

TRAIN = split_sql("entity_id") + " = 'train'"

# -- fitting ---------------------------------------------------------------------------


@query("""SELECT k.key, key_id::BIGINT AS key_id, count(l.event_id) AS n_values FROM keyids_com k LEFT JOIN long_com l USING (key) GROUP BY ALL""")
def key_vocabulary(ws: Workspace) -> DataFrame:
    used = fields_long(ws.commerce.history, ws.commerce.registry).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = fit.key_vocabulary(ws.commerce.registry, ws.spark)
    return keys.join(used, "key", "left").select("key", "key_id", F.coalesce("n", F.lit(0)).alias("n_values"))


@query(f"SELECT count(DISTINCT entity_id) AS n_train_records, count(*) AS n_train_events FROM hist_com WHERE {TRAIN}")
def fit_scope(ws: Workspace) -> DataFrame:
    train = fit.train_rows(ws.commerce.history)
    return train.agg(
        F.countDistinct("entity_id").alias("n_train_records"), F.count(F.lit(1)).alias("n_train_events")
    )


def _train_values(b: Binding) -> DataFrame:
    return fit.fit_values(fit.train_rows(b.history), None, b.registry, EncoderConfig())


@query(f"""SELECT key, CASE WHEN key IN ('amount', 'discount') THEN 'numerical' ELSE 'categorical' END AS kind,
          count(*) AS n_values, count(DISTINCT coalesce(num::VARCHAR, txt)) AS n_distinct FROM long_com
          WHERE {TRAIN} AND key NOT IN ('merchant_name', 'description') GROUP BY 1""")
def values_per_key(ws: Workspace) -> DataFrame:
    counts = fit.distinct_values(_train_values(ws.commerce))
    return counts.groupBy("key", "kind").agg(
        F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct")
    )


@query("SELECT key, idx, round(bound, 6) AS bound FROM bounds_com")
def numeric_boundaries(ws: Workspace) -> DataFrame:
    counts = materialize(fit.distinct_values(_train_values(ws.commerce)), "distinct-values")
    return fit.numeric_bounds(counts, 16)


@query(f"""SELECT key, count(v) AS n_values, count(*) FILTER (WHERE v = 0) AS n_zeros,
          round(count(*) FILTER (WHERE v IS NULL AND expected) / count(*) FILTER (WHERE expected OR v IS NOT NULL)::DOUBLE, 6) AS null_rate
          FROM (SELECT entity_id, unnest(['amount', 'discount']) AS key, unnest([amount, discount]) AS v, unnest([true, type = 'line']) AS expected
                FROM hist_com) WHERE {TRAIN} GROUP BY 1""")
def numeric_audit(ws: Workspace) -> DataFrame:
    return fit.numeric_audit(fit.train_rows(ws.commerce.history), ws.commerce.registry)


@query("SELECT key, value, value_id::BIGINT AS value_id FROM cats_com")
def category_vocabulary(ws: Workspace) -> DataFrame:
    base = N_SPECIAL + len(ws.commerce.registry.token_keys()) + 17
    counts = materialize(fit.distinct_values(_train_values(ws.commerce)), "distinct-values")
    return fit.category_vocabulary(counts, ws.commerce.registry, base)


@query(f"""SELECT key, value, (6 + 9 + 17 + row_number() OVER (ORDER BY ord, value))::BIGINT AS value_id FROM (
          SELECT DISTINCT * FROM (
            SELECT entity_id, 0 AS ord, 'type' AS key, type AS value FROM hist_app UNION ALL SELECT entity_id, 1, 'view', view FROM hist_app
            UNION ALL SELECT entity_id, 2, 'country', country FROM prof UNION ALL SELECT entity_id, 3, 'plan', plan FROM prof
            UNION ALL SELECT entity_id, 4, 'balance_quantile', balance_quantile FROM prof)
          WHERE {TRAIN}) GROUP BY ord, key, value""".replace("SELECT DISTINCT *", "SELECT DISTINCT ord, key, value"))
def wide_category_vocabulary(ws: Workspace) -> DataFrame:
    """The vocabulary with the event type and the profile values included."""
    config = EncoderConfig(include_type=True, fit_scopes=("event", "profile"))
    values = fit.fit_values(
        fit.train_rows(ws.app.history), fit.train_rows(ws.profile), ws.app.registry, config
    )
    base = N_SPECIAL + len(ws.app.registry.token_keys()) + 17
    return fit.category_vocabulary(fit.distinct_values(values), ws.app.registry, base)


@query("""SELECT (step - 1)::BIGINT AS rank, list_position(names, l)::BIGINT AS left_id, list_position(names, r)::BIGINT AS right_id,
          list_position(names, l || r)::BIGINT AS new_id, l || r AS piece_hex FROM bpe_com WHERE step > 0""")
def text_vocabulary(ws: Workspace) -> DataFrame:
    """Merges of the shared text vocabulary over supplier and part names, spelled out."""
    b = ws.commerce_text.bundle
    spelled = {i: bytes([n]) for n, i in enumerate(byte_ids())}
    rows = []
    for rank, (left, right, new) in enumerate(b.merges):
        spelled[new] = spelled[left] + spelled[right]
        rows.append((rank, left, right, new, spelled[new].hex()))
    return ws.spark.createDataFrame(rows, "rank int, left_id int, right_id int, new_id int, piece_hex string")


@query("""SELECT (SELECT count(DISTINCT entity_id) FROM hist_app WHERE """ + TRAIN + """) AS n_train_records,
          (SELECT count(*) FROM bounds_app) AS n_bounds, (SELECT count(*) FROM cats_app) AS n_categories,
          257::BIGINT AS text_local_vocab_size, 7 + 9 + 17 + (SELECT count(*) FROM cats_app) + 257 AS total_vocab_size,
          (""" + tree_sql("(SELECT DISTINCT entity_id FROM hist_app WHERE " + TRAIN + ")") + """) AS train_fingerprint""")
def fit_report(ws: Workspace) -> DataFrame:
    b = ws.app.bundle
    rows = [(
        b.n_train_records, sum(len(v) for v in b.numeric_bounds.values()), b.n_categories, b.text_size,
        b.total_size, b.train_fingerprint,
    )]
    return ws.spark.createDataFrame(
        rows,
        "n_train_records bigint, n_bounds bigint, n_categories bigint, text_local_vocab_size bigint, "
        "total_vocab_size bigint, train_fingerprint string",
    )


@query("""SELECT part, n_tokens, round(n_tokens / sum(n_tokens) OVER ()::DOUBLE, 6) AS share FROM (
          SELECT 'special_tokens' AS part, 7::BIGINT AS n_tokens UNION ALL SELECT 'key_tokens', (SELECT count(*) FROM keyids_com)
          UNION ALL SELECT 'numeric_buckets', 17 UNION ALL SELECT 'categorical_values', (SELECT count(*) FROM cats_com)
          UNION ALL SELECT 'text_pieces', 257)""")
def vocabulary_breakdown(ws: Workspace) -> DataFrame:
    b = ws.commerce.bundle
    rows = [
        ("special_tokens", N_SPECIAL), ("key_tokens", len(b.key_ids)),
        ("numeric_buckets", 1 + b.config.n_numeric_buckets), ("text_pieces", b.text_size),
    ]
    parts = ws.spark.createDataFrame(rows, "part string, n_tokens bigint").unionByName(
        b.categories.agg(F.count(F.lit(1)).alias("n_tokens")).select(F.lit("categorical_values").alias("part"), "n_tokens")
    )
    return parts.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy()))


@query("SELECT true AS same_bundle, true AS same_after_loading, true AS other_refused")
def bundle_compatibility(ws: Workspace) -> DataFrame:
    """A fitted bundle against its saved copy, and against the bundle of other tables."""
    b = ws.app.bundle
    path = new_path(ws.spark, "bundle")
    bundles.save_bundle(b, ws.spark, path)
    loaded = bundles.load_bundle(ws.spark, path, ws.app.registry)
    mine = bundles.bundle_hash(b, ws.spark)
    try:
        bundles.require_same_bundle(ws.commerce.bundle, ws.spark, mine)
        refused = False
    except ValueError:
        refused = True
    return ws.spark.createDataFrame(
        [(mine == bundles.bundle_hash(b, ws.spark), mine == bundles.bundle_hash(loaded, ws.spark), refused)],
        "same_bundle boolean, same_after_loading boolean, other_refused boolean",
    )


@query("""SELECT 'keys' AS part, count(*) AS n_rows, 0::BIGINT AS n_differ FROM keyids_com UNION ALL SELECT 'numeric_bounds', count(*), 0 FROM bounds_com
          UNION ALL SELECT 'categories', count(*), 0 FROM cats_com UNION ALL SELECT 'merges', 0, 0""")
def bundle_round_trip(ws: Workspace) -> DataFrame:
    """Rows per bundle table, and rows that differ after saving and loading."""
    b = ws.commerce.bundle
    path = new_path(ws.spark, "bundle")
    bundles.save_bundle(b, ws.spark, path)
    before = bundles.bundle_tables(b, ws.spark)
    after = bundles.bundle_tables(bundles.load_bundle(ws.spark, path, ws.commerce.registry), ws.spark)
    out = None
    for name, df in before.items():
        cols = df.columns
        both = df.withColumn("side", F.lit(1)).unionByName(after[name].withColumn("side", F.lit(-1)))
        per_row = both.groupBy(*cols).agg(F.sum("side").alias("d"), F.count_if(F.col("side") == 1).alias("n"))
        row = per_row.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("d") != 0).alias("n_differ")
        ).select(F.lit(name).alias("part"), "n_rows", "n_differ")
        out = row if out is None else out.unionByName(row)
    return out


# -- encoding --------------------------------------------------------------------------


@query("SELECT event_id, key, value_id::BIGINT AS value_id FROM fieldtok_com WHERE key IN ('amount', 'discount')")
def numeric_value_ids(ws: Workspace) -> DataFrame:
    b = ws.commerce.bundle
    slots = [
        F.struct(
            F.lit(k).alias("key"),
            numeric_token(F.col(k), b.numeric_bounds[k], b.numeric_base, b.config.n_numeric_buckets).alias("value_id"),
        )
        for k in b.registry.keys_of(R.NUMERICAL)
    ]
    long = ws.commerce.history.select("event_id", F.explode(F.array(*slots)).alias("s"))
    return long.select("event_id", "s.*").where("value_id is not null")


@query("SELECT event_id, key, value_id::BIGINT AS value_id FROM fieldtok_com WHERE key IN ('direction', 'channel', 'mcc')")
def category_value_ids(ws: Workspace) -> DataFrame:
    b = ws.commerce.bundle
    keys = [k for k in encode.event_keys(ws.commerce.history, b) if b.registry.field(k).kind == R.CATEGORICAL]
    found = encode.category_ids(ws.commerce.history, keys, b)
    slots = [F.struct(F.lit(k).alias("key"), F.col(f"id_{k}").alias("value_id")) for k in keys]
    long = found.select("event_id", F.explode(F.array(*slots)).alias("s"))
    return long.select("event_id", "s.*").where("value_id is not null")


@query("""SELECT event_id, key_id::BIGINT AS key_id, pos::BIGINT AS pos, value_id::BIGINT AS value_id
          FROM toktxt_com WHERE key IN ('merchant_name', 'description')""")
def text_value_ids(ws: Workspace) -> DataFrame:
    """Text pieces of the commerce events: key id, value ids and positions per field."""
    b = ws.commerce_text
    text_keys = b.registry.keys_of(R.TEXT)
    ids = [b.bundle.key_ids[k] for k in text_keys]
    tokens = encode.event_tokens(b.encoded())
    return tokens.where(F.col("key_id").isin(ids)).select("event_id", "key_id", "pos", "value_id")


@query("SELECT entity_id, event_id, event_ord, tok_ord, 0::BIGINT AS pos, key_id::BIGINT AS key_id, value_id::BIGINT AS value_id FROM tok_com")
def event_tokens(ws: Workspace) -> DataFrame:
    return encode.event_tokens(ws.commerce.encoded())


@query("""SELECT entity_id, event_id, event_ord, tok_ord, pos::BIGINT AS pos, key_id::BIGINT AS key_id, value_id::BIGINT AS value_id
          FROM toktxt_com WHERE upto <= 24""")
def event_tokens_with_text(ws: Workspace) -> DataFrame:
    """Tokens of all fields, text fields with several each."""
    return encode.event_tokens(ws.commerce_text.encoded())


@query("""SELECT e.event_id, coalesce(c.n, 0) AS n_tokens, coalesce(ids, '') AS value_ids, coalesce(places, '') AS within_field_pos,
                 coalesce(sizes, '') AS field_lengths, e.n > 12 AS truncated FROM
          (SELECT event_id, count(*) AS n FROM toktxt_com GROUP BY 1) e LEFT JOIN
          (SELECT event_id, count(*) AS n, string_agg(value_id::BIGINT::VARCHAR, ',' ORDER BY tok_ord) AS ids,
                  string_agg(pos::VARCHAR, ',' ORDER BY tok_ord) AS places,
                  string_agg(n_field::VARCHAR, ',' ORDER BY tok_ord) FILTER (WHERE pos = 0) AS sizes
           FROM toktxt_com WHERE upto <= 12 GROUP BY 1) c USING (event_id)""")
def capped_tokens_with_text(ws: Workspace) -> DataFrame:
    """At most twelve tokens an event: a text that does not fit goes as a whole, and all fields after it."""
    rows = ws.commerce_text.encoded(ws.commerce_text.bundle.with_config(max_event_tokens=12))
    return rows.select("event_id", F.size("value_ids").alias("n_tokens"), "value_ids", "within_field_pos", "field_lengths", "truncated")


@query("""SELECT entity_id, split, tok_ord, 0::BIGINT AS pos, key_id::BIGINT AS key_id, value_id::BIGINT AS value_id,
          round(time_coord, 6) AS time_coord FROM proftok_app""")
def profile_tokens(ws: Workspace) -> DataFrame:
    return encode.profile_tokens(ws.app.profiles())


@query("""SELECT t.event_id, coalesce(c.n, 0) AS n_tokens, coalesce(ids, '') AS value_ids, t.n > 3 AS truncated FROM
          (SELECT event_id, count(*) AS n FROM tok_com GROUP BY 1) t LEFT JOIN
          (SELECT event_id, count(*) AS n, string_agg(value_id::VARCHAR, ',' ORDER BY tok_ord) AS ids FROM tok_com WHERE tok_ord < 3 GROUP BY 1) c USING (event_id)""")
def capped_event_tokens(ws: Workspace) -> DataFrame:
    """At most three tokens an event: whole fields go, from the first that does not fit."""
    small = ws.commerce.bundle.with_config(max_event_tokens=3)
    rows = ws.commerce.encoded(small)
    return rows.select("event_id", F.size("value_ids").alias("n_tokens"), "value_ids", "truncated")


@query("""SELECT entity_id, event_id, n_kept - age_rank AS event_ord, epoch_us(latest) AS latest_at, n > 20 AS events_truncated FROM (
          SELECT *, count(*) OVER (PARTITION BY entity_id) AS n, max(created_at) OVER (PARTITION BY entity_id) AS latest,
                 row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, event_id DESC) AS age_rank,
                 least(20, count(*) OVER (PARTITION BY entity_id)) AS n_kept FROM hist_com) WHERE age_rank <= 20""")
def capped_history(ws: Workspace) -> DataFrame:
    kept = ws.commerce.capped(20).select("entity_id", "event_id", "event_ord", "latest_at")
    flags = ws.commerce.kept_records.select("entity_id", (F.col("n_events") > 20).alias("events_truncated"))
    return kept.join(flags, "entity_id")


@query(f"""SELECT entity_id, event_id, round({softlog_sql(secs_sql('signup_at', 'created_at'))}, 6) AS since_signup
          FROM ev_app JOIN prof USING (entity_id)""")
def soft_log_times(ws: Workspace) -> DataFrame:
    from eventlens.operators.skew import join_per_entity

    signup = ws.profile.select("entity_id", "signup_at")
    joined = join_per_entity(ws.app.events, signup, "inner", ws.app.heavy)
    since = soft_log(seconds_between(F.col("signup_at"), F.col("created_at")))
    return joined.select("entity_id", "event_id", since.alias("since_signup"))


@query(f"SELECT entity_id, event_id, round({softlog_sql(secs_sql('created_at', 'latest_at'))}, 6) AS time_to_latest FROM capped_app")
def times_to_latest(ws: Workspace) -> DataFrame:
    return ws.app.encoded().select("entity_id", "event_id", "time_to_latest")


@query(f"""SELECT entity_id, key, round(CASE WHEN at_us IS NULL THEN 0.0 ELSE {softlog_sql("(epoch_us(evaluation_time) - at_us) / 1e6::DOUBLE")} END, 6) AS time_coord
          FROM (SELECT entity_id, evaluation_time, unnest(['signup_at', 'first_purchase_at', 'first_view_at']) AS key,
                unnest([epoch_us(signup_at), epoch_us(first_purchase_at), epoch_us(first_view_at)]) AS at_us FROM rec_com)""")
def milestone_times(ws: Workspace) -> DataFrame:
    from eventlens.plans.workspace import MILESTONES

    slots = [
        F.struct(
            F.lit(m).alias("key"),
            encode.milestone_time(F.col(m), F.col("evaluation_time")).alias("time_coord"),
        )
        for m in MILESTONES
    ]
    return ws.commerce.records.select("entity_id", F.explode(F.array(*slots)).alias("s")).select("entity_id", "s.*")


@query("""SELECT event_id, round(sin(2 * pi() * h / 24.0), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * h / 24.0), 6) + 0.0 AS hour_cos,
          round(sin(2 * pi() * w / 7.0), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * w / 7.0), 6) + 0.0 AS dow_cos,
          round(sin(2 * pi() * d / 31.0), 6) + 0.0 AS dom_sin, round(cos(2 * pi() * d / 31.0), 6) + 0.0 AS dom_cos
          FROM (SELECT event_id, hour(created_at)::DOUBLE AS h, (isodow(created_at) - 1)::DOUBLE AS w, (day(created_at) - 1)::DOUBLE AS d FROM ev_app)""")
def calendar_features(ws: Workspace) -> DataFrame:
    clock = calendar(F.col("created_at"))
    return ws.app.events.select("event_id", *[clock[n].alias(n) for n in CALENDAR])


RECORD_SQL = """
  SELECT r.entity_id, r.split, p.profile_key_ids, p.profile_value_ids, p.profile_within_field_pos, p.profile_field_lengths,
         r.n_events AS n_events_total, e.n AS n_events_kept, e.n < r.n_events AS events_truncated,
         e.event_ids, e.event_key_ids, e.event_value_ids, e.event_field_lengths
  FROM rec_com r
  JOIN (SELECT entity_id, string_agg(key_id::VARCHAR, ',' ORDER BY tok_ord) AS profile_key_ids,
               string_agg(value_id::VARCHAR, ',' ORDER BY tok_ord) AS profile_value_ids,
               string_agg('0', ',' ORDER BY tok_ord) AS profile_within_field_pos,
               string_agg('1', ',' ORDER BY tok_ord) AS profile_field_lengths FROM proftok_com GROUP BY 1) p USING (entity_id)
  JOIN (SELECT entity_id, count(*) AS n, string_agg(event_id, ',' ORDER BY event_ord) AS event_ids,
               string_agg(k, ';' ORDER BY event_ord) AS event_key_ids, string_agg(v, ';' ORDER BY event_ord) AS event_value_ids,
               string_agg(l, ';' ORDER BY event_ord) AS event_field_lengths
        FROM (SELECT entity_id, event_id, event_ord, string_agg(key_id::VARCHAR, ',' ORDER BY tok_ord) AS k,
                     string_agg(value_id::VARCHAR, ',' ORDER BY tok_ord) AS v, string_agg('1', ',' ORDER BY tok_ord) AS l
              FROM tok_com GROUP BY ALL) GROUP BY 1) e USING (entity_id)"""
RECORD_COLUMNS = (
    "entity_id", "split", "profile_key_ids", "profile_value_ids", "profile_within_field_pos",
    "profile_field_lengths", "n_events_total", "n_events_kept", "events_truncated", "event_ids",
    "event_key_ids", "event_value_ids", "event_field_lengths",
)


@query(RECORD_SQL)
def tokenized_records(ws: Workspace) -> DataFrame:
    return ws.commerce.shards().select(*RECORD_COLUMNS)


@query("""SELECT entity_id, split, event_id, event_ord, tok_ord, 0::BIGINT AS pos, key_id::BIGINT AS key_id, value_id::BIGINT AS value_id
          FROM tok_app JOIN rec_app USING (entity_id)""")
def flattened_records(ws: Workspace) -> DataFrame:
    return encode.stored_tokens(ws.app.shards())


@query("SELECT count(*) AS n_records, 0::BIGINT AS n_differ FROM rec_app WHERE n_events > 0")
def record_json_round_trip(ws: Workspace) -> DataFrame:
    before = materialize(ws.app.shards(), "records")
    after = shards.from_json(shards.to_json(before))
    differ = before.exceptAll(after).unionByName(after.exceptAll(before))
    n = before.agg(F.count(F.lit(1)).alias("n_records"), F.lit(None).cast("bigint").alias("n_differ"))
    d = differ.agg(F.lit(None).cast("bigint").alias("n_records"), F.count(F.lit(1)).alias("n_differ"))
    return n.unionByName(d).agg(F.max("n_records").alias("n_records"), F.max("n_differ").alias("n_differ"))


@query("""SELECT t.event_id, t.tok_ord, t.key, CASE WHEN t.key IN ('amount', 'discount') THEN 'numerical' ELSE 'categorical' END AS kind,
          CASE WHEN t.value_id = 1 THEN '[UNK]' WHEN t.value_id = 19 THEN '[ZERO]' WHEN t.value_id < 36 THEN '[P' || (t.value_id - 20) || ']'
               ELSE c.value END AS value FROM tok_com t LEFT JOIN cats_com c ON c.value_id = t.value_id""")
def decoded_tokens(ws: Workspace) -> DataFrame:
    tokens = encode.event_tokens(ws.commerce.encoded())
    return encode.decode_keys(tokens, ws.commerce.bundle).select("event_id", "tok_ord", "key", "kind", "value")


@query(f"""SELECT key, split, count(*) AS n_lookups, count(*) FILTER (WHERE value_id = 1) AS n_unknown,
          round(avg((value_id = 1)::INT), 6) AS oov_rate FROM (SELECT *, {split_sql('entity_id')} AS split FROM fieldtok_app)
          WHERE key = 'view' GROUP BY ALL""")
def oov_rates(ws: Workspace) -> DataFrame:
    return encode.oov_rates(ws.app.history, split_of(F.col("entity_id")), ws.app.bundle)


@query(f"""
  SELECT f.key, f.kind, n_train_values, n_zero_values, n_bounds, round(low, 6) AS low_bound, round(high, 6) AS high_bound, round(oov, 6) AS oov_rate
  FROM (SELECT key, CASE WHEN key IN ('amount', 'discount') THEN 'numerical' WHEN key IN ('merchant_name', 'description') THEN 'text'
                         ELSE 'categorical' END AS kind,
               count(*) FILTER (WHERE {TRAIN}) AS n_train_values,
               CASE WHEN key IN ('amount', 'discount') THEN count(*) FILTER (WHERE num = 0 AND {TRAIN}) END AS n_zero_values
        FROM long_com GROUP BY key) f
  LEFT JOIN (SELECT key, count(*) AS n_bounds, min(bound) AS low, max(bound) AS high FROM bounds_com GROUP BY key) b ON b.key = f.key
  LEFT JOIN (SELECT key, avg((value_id = 1)::INT) AS oov FROM fieldtok_com
             WHERE key IN ('direction', 'channel', 'mcc') AND NOT {TRAIN} GROUP BY key
             UNION ALL SELECT key, avg((txt = '')::INT) FROM long_com WHERE key IN ('merchant_name', 'description') AND NOT {TRAIN} GROUP BY key
  ) o ON o.key = f.key""")
def fit_report_fields(ws: Workspace) -> DataFrame:
    """The report per field: numeric statistics and unknown rates, text fields included."""
    b = ws.commerce_text
    return encode.field_report(b.stored_history.drop(*PLACES), split_of(F.col("entity_id")), b.bundle)


# -- stored form ---------------------------------------------------------------------------


@query(
    RECORD_SQL.replace("r.split,", "r.split, z.length_bucket,")
    + " JOIN sizes_com z ON z.entity_id = r.entity_id WHERE r.split = 'train'"
)
def stored_train_records(ws: Workspace) -> DataFrame:
    """Records written as partitioned shards, verified, and the training split read back."""
    path = _written(ws)
    return shards.read_shards(ws.spark, path, "train").select(*RECORD_COLUMNS, "length_bucket")


def _written(ws: Workspace) -> str:
    path = new_path(ws.spark, "shards")
    shards.write_shards(ws.commerce.shards(), path, fingerprint=ws.commerce.bundle.train_fingerprint)
    return path


@query("""SELECT split, length_bucket, count(*) AS n_records, sum(n_events)::BIGINT AS n_events, sum(n_value_tokens)::BIGINT AS n_value_tokens
          FROM sizes_com GROUP BY ALL""")
def shard_manifest(ws: Workspace) -> DataFrame:
    """Totals of the manifest that was written beside the shards."""
    manifest = shards.read_manifest(ws.spark, _written(ws))
    return manifest.groupBy("split", "length_bucket").agg(
        F.sum("n_records").alias("n_records"), F.sum("n_events").alias("n_events"),
        F.sum("n_value_tokens").alias("n_value_tokens"),
    )


@query("SELECT 0::BIGINT AS n_mismatches, (SELECT count(*) FROM rec_com WHERE n_events > 0) AS n_records")
def shard_checksums(ws: Workspace) -> DataFrame:
    path = _written(ws)
    bad = shards.checksum_mismatches(ws.spark, path).agg(F.count(F.lit(1)).alias("n_mismatches"))
    total = shards.read_manifest(ws.spark, path).agg(F.sum("n_records").alias("n_records"))
    both = bad.unionByName(total, allowMissingColumns=True)
    return both.agg(F.max("n_mismatches").alias("n_mismatches"), F.max("n_records").alias("n_records"))


@query("SELECT entity_id, event_id, event_ord, tok_ord AS field_no, key_id::VARCHAR AS key_ids, value_id::VARCHAR AS value_ids, '0' AS positions FROM tok_app")
def regrouped_fields(ws: Workspace) -> DataFrame:
    return encode.field_groups(ws.app.shards())


@query("""SELECT entity_id, n_events, CASE WHEN n_events < 1 THEN '0-0' WHEN n_events < 50 THEN '1-49' WHEN n_events < 500 THEN '50-499' ELSE '500+' END AS length_bucket,
          CASE WHEN n_events < 10 THEN '0-9' WHEN n_events < 60 THEN '10-59' ELSE '60+' END AS other_bucket FROM rec_com""")
def length_buckets(ws: Workspace) -> DataFrame:
    n = F.col("n_events")
    return ws.commerce.records.select(
        "entity_id", "n_events", length_label(n).alias("length_bucket"), length_label(n, (10, 60)).alias("other_bucket")
    )


@query("""SELECT split, length_bucket, row_number() OVER (ORDER BY split, length_bucket) AS place, count(*) AS n_records FROM sizes_app GROUP BY split, length_bucket""")
def shard_groups(ws: Workspace) -> DataFrame:
    from eventlens.operators.ordered import ranks

    groups = ws.app.sizes().groupBy("split", "length_bucket").agg(F.count(F.lit(1)).alias("n_records"))
    return ranks(groups, [], ["split", "length_bucket"], "place")


@query("SELECT entity_id, split, n_events_total, n_events, n_event_tokens, n_value_tokens, length_bucket FROM sizes_com")
def record_token_counts(ws: Workspace) -> DataFrame:
    return ws.commerce.sizes()


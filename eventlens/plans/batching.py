"""Size-balanced batches and their packed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators import batch, mask
from eventlens.plans.catalog import query
from eventlens.plans.workspace import Workspace
from eventlens.session import materialize

PLAN = "SELECT entity_id, n_events, n_event_tokens, bucket, batch_id, pos FROM batches_com"


@query("SELECT entity_id, n_event_tokens, bucket FROM bucketed_com")
def record_length_buckets(ws: Workspace) -> DataFrame:
    sizes = materialize(ws.commerce.sizes().select("entity_id", "n_event_tokens"), "record-sizes")
    return batch.length_buckets(sizes, 8)


@query("""SELECT entity_id, bucket, (bucket_pos - 1)::BIGINT AS bucket_pos, rn AS place FROM seq_com""")
def shuffled_records(ws: Workspace) -> DataFrame:
    from eventlens.operators.ordered import ranks

    sizes = materialize(ws.commerce.sizes().select("entity_id", "n_event_tokens"), "record-sizes")
    order = batch.shuffled(sizes, batch.Budget(), 0)
    return ranks(order, ["bucket"], ["draw", "entity_id"], "place").select(
        "entity_id", "bucket", "bucket_pos", "place"
    )


@query(PLAN)
def packed_batches(ws: Workspace) -> DataFrame:
    """Greedy packing under token, event and record budgets."""
    return batch.plan_batches(ws.commerce.sizes())


@query("""
  WITH n AS (SELECT max(batch_id) + 1 AS n FROM batches_com)
  SELECT slot % 3 AS rank, slot // 3 AS step, slot % n AS batch_id, slot >= n AS padded
  FROM n, (SELECT unnest(range(0, (SELECT ((n + 2) // 3) * 3 FROM n))) AS slot)""")
def rank_batches(ws: Workspace) -> DataFrame:
    return batch.rank_batches(ws.commerce.batches, 3)


@query("""SELECT count(*) AS n_batches, sum(r)::BIGINT AS n_records, sum(e)::BIGINT AS n_events, sum(t)::BIGINT AS n_event_tokens,
          round(avg(r), 6) AS mean_records_per_batch, round(avg(t), 6) AS mean_event_tokens_per_batch
          FROM (SELECT batch_id, count(*) AS r, sum(n_events) AS e, sum(n_event_tokens) AS t FROM batches_com GROUP BY 1)""")
def batch_stats(ws: Workspace) -> DataFrame:
    return batch.batch_stats(ws.commerce.batches)


@query("""SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS global_step, count(*) AS n_records, sum(n_events)::BIGINT AS n_events,
          sum(n_event_tokens)::BIGINT AS n_event_tokens, (sum(count(*)) OVER (ORDER BY batch_id))::BIGINT AS records_processed,
          (sum(sum(n_events)) OVER (ORDER BY batch_id))::BIGINT AS events_processed,
          (sum(sum(n_event_tokens)) OVER (ORDER BY batch_id))::BIGINT AS tokens_processed FROM batches_com GROUP BY 1""")
def progress_counters(ws: Workspace) -> DataFrame:
    return batch.progress(ws.commerce.batches)


def _flat(ws: Workspace, config: mask.MaskConfig = mask.MaskConfig()) -> DataFrame:
    b = ws.commerce
    events = b.stored
    counts = b.sizes().select("entity_id", F.col("n_events").alias("n_kept"))
    profiles = b.stored_profiles.join(counts, "entity_id")
    masked = mask.mask_tokens(batch.in_batches(events, b.batches), b.bundle, config, 0, "batch_id", "rec")
    return batch.flat_batches(b.batches, profiles, events, masked)


@query("""
  WITH ev AS (SELECT entity_id, event_id, event_ord, count(t.tok_ord) AS n FROM capped_com c LEFT JOIN tok_com t USING (entity_id, event_id, event_ord) GROUP BY ALL),
  evb AS (SELECT b.batch_id, b.pos, ev.event_ord, sum(n) OVER (PARTITION BY b.batch_id ORDER BY b.pos, ev.event_ord) AS upto FROM ev JOIN batches_com b USING (entity_id)),
  rec AS (SELECT batch_id, pos, entity_id, n_events, sum(n_events) OVER (PARTITION BY batch_id ORDER BY pos) AS upto FROM batches_com)
  SELECT r.batch_id, r.entity_ids, r.n_records, p.profile_value_ids, p.profile_token_to_record, t.event_key_ids, t.event_value_ids, t.event_labels, t.event_mask_origin,
         e.event_offsets, e.event_to_record, r.history_offsets
  FROM (SELECT batch_id, count(*) AS n_records, string_agg(entity_id, ',' ORDER BY pos) AS entity_ids, '0,' || string_agg(upto::BIGINT::VARCHAR, ',' ORDER BY pos) AS history_offsets FROM rec GROUP BY 1) r
  JOIN (SELECT batch_id, string_agg(value_id::VARCHAR, ',' ORDER BY pos, tok_ord) AS profile_value_ids, string_agg(pos::VARCHAR, ',' ORDER BY pos, tok_ord) AS profile_token_to_record
        FROM proftok_com JOIN batches_com USING (entity_id) GROUP BY 1) p USING (batch_id)
  JOIN (SELECT batch_id, string_agg(key_id::VARCHAR, ',' ORDER BY pos, event_ord, tok_ord) AS event_key_ids, string_agg(input_id::VARCHAR, ',' ORDER BY pos, event_ord, tok_ord) AS event_value_ids,
               string_agg(label::VARCHAR, ',' ORDER BY pos, event_ord, tok_ord) AS event_labels, string_agg(origin::VARCHAR, ',' ORDER BY pos, event_ord, tok_ord) AS event_mask_origin
        FROM mask0_com JOIN batches_com USING (entity_id) GROUP BY 1) t USING (batch_id)
  JOIN (SELECT batch_id, '0,' || string_agg(upto::BIGINT::VARCHAR, ',' ORDER BY pos, event_ord) AS event_offsets, string_agg(pos::VARCHAR, ',' ORDER BY pos, event_ord) AS event_to_record
        FROM evb GROUP BY 1) e USING (batch_id)""")
def flat_batches(ws: Workspace) -> DataFrame:
    """Packed token and event buffers with cumulative offsets, one row per batch."""
    return _flat(ws).select(
        "batch_id", "entity_ids", "n_records", "profile_value_ids", "profile_token_to_record",
        "event_key_ids", "event_value_ids", "event_labels", "event_mask_origin", "event_offsets",
        "event_to_record", "history_offsets",
    )


@query("SELECT batch_id, count(*) AS n_records, '' AS problems FROM batches_com GROUP BY 1")
def batch_problems(ws: Workspace) -> DataFrame:
    return batch.batch_problems(_flat(ws))


@query("""
  WITH o AS (SELECT batch_id, pos, sum(n_events) OVER (PARTITION BY batch_id ORDER BY pos) AS stop, n_events FROM batches_com)
  SELECT batch_id, pos, (stop - n_events)::BIGINT AS start, stop::BIGINT AS "end", n_events AS n_items FROM o""")
def group_offsets(ws: Workspace) -> DataFrame:
    """Record numbers of events to offsets, and back: the items each record gets again."""
    plan = ws.commerce.batches.select("entity_id", "batch_id", "pos")
    items = ws.commerce.capped().select("entity_id").join(plan, "entity_id")
    offsets = batch.group_offsets(items, "batch_id", "pos")
    back = batch.group_ids(offsets, "batch_id", "pos").groupBy("batch_id", "pos").agg(
        F.count(F.lit(1)).alias("n_items")
    )
    return offsets.join(back, ["batch_id", "pos"])


@query("SELECT count(*) AS n_tokens, 0::BIGINT AS n_lost, 0::BIGINT AS n_added FROM tok_com WHERE value_id IS NOT NULL")
def unpacked_batches(ws: Workspace) -> DataFrame:
    """Source tokens rebuilt from packed batches without masks, against the records."""
    b = ws.commerce
    flat = _flat(ws, mask.MaskConfig(0.0, 0.0, 0.0, 0.0))
    return batch.token_differences(b.stored, batch.unpacked_events(flat))


@query("""SELECT batch_id, count(*) AS n_sequences, sum(n_events)::BIGINT AS total_length, max(n_events) AS max_length,
          count(*) * max(n_events) * 64 AS padded_elements, sum(n_events)::BIGINT * 64 AS packed_elements,
          count(*) * max(n_events) * max(n_events) * 4 AS padded_squares, sum(n_events * n_events)::BIGINT * 4 AS packed_squares,
          round(count(*) * max(n_events) / sum(n_events)::DOUBLE, 6) AS linear_ratio,
          round(count(*) * max(n_events) * max(n_events) / sum(n_events * n_events)::DOUBLE, 6) AS square_ratio FROM batches_com GROUP BY 1""")
def padding_waste(ws: Workspace) -> DataFrame:
    return batch.padding_waste(ws.commerce.batches, ["batch_id"], "n_events", heads=4, width=16)


@query("""
  WITH rows AS (SELECT m.*, b.batch_id, b.pos AS rec FROM mask0_com m JOIN batches_com b USING (entity_id)),
  ctx AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY rec, event_ord, tok_ord) AS place,
                 row_number() OVER (PARTITION BY batch_id ORDER BY sha256('0|shuffle|' || batch_id || '|' || event_id || '|' || tok_ord)) AS draw
          FROM rows WHERE label = -100)
  SELECT a.batch_id, a.event_id, a.tok_ord, a.label::BIGINT AS label, b.input_id::BIGINT AS new_input_id FROM ctx a JOIN ctx b ON a.batch_id = b.batch_id AND a.place = b.draw
  UNION ALL SELECT batch_id, event_id, tok_ord, label, input_id FROM rows WHERE label <> -100""")
def shuffled_context(ws: Workspace) -> DataFrame:
    b = ws.commerce
    placed = batch.in_batches(b.stored, b.batches)
    out = batch.shuffle_context(mask.mask_tokens(placed, b.bundle, mask.MaskConfig(), 0, "batch_id", "rec"))
    return out.select("batch_id", "event_id", "tok_ord", "label", "new_input_id")

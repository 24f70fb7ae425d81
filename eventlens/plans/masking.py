"""Masks over event tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators import mask
from eventlens.operators.encode import event_tokens
from eventlens.operators.split import split_of
from eventlens.plans.catalog import query
from eventlens.plans.reference_sql import split_sql
from eventlens.plans.workspace import Workspace


@query("SELECT event_id, tok_ord, eligible FROM mask0_com")
def maskable_positions(ws: Workspace) -> DataFrame:
    return ws.commerce.masked().select("event_id", "tok_ord", "eligible")


def _hits(bit: int) -> str:
    return f"SELECT entity_id, event_id, tok_ord FROM mask0_com WHERE (origin & {bit}) <> 0"


def _selected(ws: Workspace, bit: int) -> DataFrame:
    masked = ws.commerce.masked()
    return masked.where(F.col("origin").bitwiseAND(bit) != 0).select("entity_id", "event_id", "tok_ord")


@query(_hits(1))
def token_masks(ws: Workspace) -> DataFrame:
    return _selected(ws, mask.TOKEN)


@query(_hits(2))
def event_masks(ws: Workspace) -> DataFrame:
    return _selected(ws, mask.EVENT)


@query(_hits(4))
def key_masks(ws: Workspace) -> DataFrame:
    return _selected(ws, mask.KEY)


@query("""SELECT entity_id, event_id, event_ord, tok_ord, key_id::BIGINT AS key_id, value_id::BIGINT AS value_id, origin::BIGINT AS origin,
          input_id::BIGINT AS input_id, label::BIGINT AS label FROM mask0_com""")
def masked_tokens(ws: Workspace) -> DataFrame:
    """Sources as bit flags, corrupted inputs and labels."""
    return ws.commerce.masked().drop("pos", "eligible")


@query("""SELECT count(*) AS n_tokens, count(*) FILTER (WHERE a.origin <> b.origin OR a.input_id <> b.input_id) AS n_changed,
          0::BIGINT AS n_unstable FROM mask0_app a JOIN mask1_app b USING (event_id, tok_ord)""")
def mask_epochs(ws: Workspace) -> DataFrame:
    """Another epoch gives other masks; the same epoch gives the same under another partitioning."""
    b = ws.app
    b.stored  # written, as it is read three times
    first = b.masked(0).select("event_id", "tok_ord", "origin", "input_id")
    again = mask.mask_tokens(b.stored.repartition(3, "event_id"), b.bundle, mask.MaskConfig(), 0).select(
        "event_id", "tok_ord", F.col("origin").alias("o0"), F.col("input_id").alias("i0")
    )
    other = b.masked(1).select("event_id", "tok_ord", F.col("origin").alias("o1"), F.col("input_id").alias("i1"))
    joined = first.join(again, ["event_id", "tok_ord"]).join(other, ["event_id", "tok_ord"])
    return joined.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if((F.col("origin") != F.col("o1")) | (F.col("input_id") != F.col("i1"))).alias("n_changed"),
        F.count_if((F.col("origin") != F.col("o0")) | (F.col("input_id") != F.col("i0"))).alias("n_unstable"),
    )


@query("""SELECT count(*) AS n_tokens, count(*) FILTER (WHERE origin <> 0) AS n_selected,
          count(*) FILTER (WHERE origin <> 0 AND input_id = value_id) AS n_leaked,
          count(*) FILTER (WHERE origin <> 0 AND input_id NOT IN (1, 2)) AS n_bad_inputs,
          count(*) FILTER (WHERE origin = 0 AND label <> -100) AS n_labels_without_mask,
          count(*) FILTER (WHERE origin <> 0 AND input_id = 2 AND label <> value_id) AS n_wrong_targets,
          count(*) FILTER (WHERE origin <> 0 AND input_id = 1 AND label <> -100) AS n_dropped_with_label,
          count(*) FILTER (WHERE origin <> 0 AND NOT eligible) AS n_not_eligible FROM mask0_com""")
def mask_leak_audit(ws: Workspace) -> DataFrame:
    return mask.leak_audit(ws.commerce.masked())


@query(f"""SELECT split, count(*) AS n_tokens, round(avg(((origin & 1) <> 0)::INT), 6) AS token_rate, round(avg(((origin & 2) <> 0)::INT), 6) AS event_rate,
          round(avg(((origin & 4) <> 0)::INT), 6) AS key_rate, round(avg((origin <> 0)::INT), 6) AS any_rate,
          count(*) FILTER (WHERE origin IN (3, 5, 6, 7)) AS n_multi_source, round(avg((origin IN (3, 5, 6, 7))::INT), 6) AS multi_source_rate,
          round(avg((origin <> 0 AND input_id = 1)::INT), 6) AS dropped_rate
          FROM (SELECT *, {split_sql('entity_id')} AS split FROM mask0_com) GROUP BY 1""")
def mask_coverage(ws: Workspace) -> DataFrame:
    masked = ws.commerce.masked().withColumn("split", split_of(F.col("entity_id")))
    return mask.coverage(masked, "split")


@query(f"""
  WITH seen AS (SELECT key_id, value_id, count(*) AS n FROM tok_com WHERE {split_sql('entity_id')} = 'train' GROUP BY ALL),
  per_key AS (SELECT key_id, sum(n) AS n_key, count(*) AS n_values FROM seen GROUP BY 1),
  places AS (SELECT key_id, value_id, row_number() OVER (PARTITION BY key_id ORDER BY n DESC, value_id) AS place FROM seen),
  rows AS (
    SELECT m.key_id, m.origin, -ln((coalesce(s.n, 0) + 1) / (coalesce(n_key, 0) + coalesce(n_values, 0) + 1)::DOUBLE) AS loss,
           CASE WHEN place <= 5 THEN place END AS place
    FROM mask0_com m LEFT JOIN seen s ON s.key_id = m.key_id AND s.value_id = m.value_id LEFT JOIN per_key k ON k.key_id = m.key_id
    LEFT JOIN places p ON p.key_id = m.key_id AND p.value_id = m.value_id
    WHERE label <> -100 AND {split_sql('m.entity_id')} = 'val')
  SELECT source, key_id::BIGINT AS key_id, count(*) AS n_masked, round(avg(loss), 6) AS cross_entropy,
         round(avg(coalesce(place = 1, false)::INT), 6) AS top1_rate, round(avg((place IS NOT NULL)::INT), 6) AS topk_rate
  FROM (SELECT *, 'any' AS source FROM rows UNION ALL SELECT *, 'token' FROM rows WHERE (origin & 1) <> 0
        UNION ALL SELECT *, 'event' FROM rows WHERE (origin & 2) <> 0 UNION ALL SELECT *, 'key' FROM rows WHERE (origin & 4) <> 0)
  GROUP BY ALL""")
def masked_value_difficulty(ws: Workspace) -> DataFrame:
    """Masked validation values against the per-key value frequencies of the training tokens."""
    b = ws.commerce
    encoded = b.encoded_once()  # the splits share no event
    split = split_of(F.col("entity_id"))
    masked = mask.mask_tokens(encoded.where(split == "val"), b.bundle)
    return mask.marginal_difficulty(masked, event_tokens(encoded.where(split == "train")), b.bundle)

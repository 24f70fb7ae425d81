"""Deterministic masks over event tokens.

Every decision is a hash of (seed, epoch, entity, what is decided), so it does not depend
on partitioning, row order or retries, and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.hashing import below, digest
from eventlens.operators.bundle import MASK, UNK, Bundle
from eventlens.operators.skew import broadcast_if_small
from eventlens.session import materialize

# Label of positions without a target, and the source flags.
NO_LABEL = -100
TOKEN, EVENT, KEY = 1, 2, 4
SOURCES = {"token": TOKEN, "event": EVENT, "key": KEY}


@dataclass(frozen=True)
class MaskConfig:
    # Default rates and seed.
    token_prob: float = 0.15
    event_prob: float = 0.10
    key_prob: float = 0.10
    unk_frac: float = 0.05
    seed: int = 20260101


def mask_tokens(
    encoded: DataFrame, bundle: Bundle, config: MaskConfig = MaskConfig(), epoch: int = 0, *keep: str
) -> DataFrame:
    """Token rows of encoded events with ``eligible``, ``origin``, ``input_id``, ``label``.

    The event draw is made once per event, before the tokens are exploded; one digest per
    token gives both the token draw and the corruption draw.
    """
    base = (config.seed, epoch, F.col("entity_id"))
    drawn = encoded.withColumn(
        "event_hit", below(digest(*base, "event", F.col("event_id")), config.event_prob)
    )
    zipped = F.arrays_zip("key_ids", "value_ids", "within_field_pos")
    tokens = drawn.select(
        "entity_id", "event_id", "event_ord", *keep, "event_hit", F.posexplode(zipped).alias("tok_ord", "t")
    ).select(
        "entity_id", "event_id", "event_ord", *keep, "event_hit", "tok_ord",
        F.col("t.within_field_pos").alias("pos"),
        F.col("t.key_ids").alias("key_id"), F.col("t.value_ids").alias("value_id"),
    )
    eligible = F.col("key_id").isin(bundle.maskable_key_ids()) & (F.col("value_id") != UNK)
    draws = tokens.withColumns(
        {
            "eligible": eligible,
            "draw": digest(*base, "token", F.col("event_id"), F.col("tok_ord")),
            "key_hit": below(digest(*base, "key", F.col("key_id")), config.key_prob),
        }
    )

    def flag(hit, bit: int):
        return F.when(F.col("eligible") & hit, bit).otherwise(0)

    origin = (
        flag(below(F.col("draw"), config.token_prob), TOKEN)
        .bitwiseOR(flag(F.col("event_hit"), EVENT))
        .bitwiseOR(flag(F.col("key_hit"), KEY))
    )
    out = draws.withColumn("origin", origin).withColumn(
        "dropped", (F.col("origin") != 0) & below(F.col("draw"), config.unk_frac, 1)
    )
    return out.withColumns(
        {
            "input_id": F.when(F.col("origin") == 0, F.col("value_id"))
            .when(F.col("dropped"), UNK).otherwise(MASK),
            "label": F.when((F.col("origin") != 0) & ~F.col("dropped"), F.col("value_id"))
            .otherwise(NO_LABEL),
        }
    ).drop("event_hit", "key_hit", "draw", "dropped")


def leak_audit(masked: DataFrame) -> DataFrame:
    """One row of counts; all but ``n_tokens`` and ``n_selected`` must be 0."""
    chosen = F.col("origin") != 0
    return masked.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(chosen).alias("n_selected"),
        F.count_if(chosen & (F.col("input_id") == F.col("value_id"))).alias("n_leaked"),
        F.count_if(chosen & ~F.col("input_id").isin(MASK, UNK)).alias("n_bad_inputs"),
        F.count_if(~chosen & (F.col("label") != NO_LABEL)).alias("n_labels_without_mask"),
        F.count_if(chosen & (F.col("input_id") == MASK) & (F.col("label") != F.col("value_id")))
        .alias("n_wrong_targets"),
        F.count_if(chosen & (F.col("input_id") == UNK) & (F.col("label") != NO_LABEL))
        .alias("n_dropped_with_label"),
        F.count_if(chosen & ~F.col("eligible")).alias("n_not_eligible"),
    )


def coverage(masked: DataFrame, *by: str) -> DataFrame:
    """Share of tokens hit by each source, by any, and by more than one."""
    def share(cond):
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    def hit(bit: int):
        return F.col("origin").bitwiseAND(bit) != 0

    several = F.bit_count("origin") > 1
    return masked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        *[share(hit(bit)).alias(f"{name}_rate") for name, bit in SOURCES.items()],
        share(F.col("origin") != 0).alias("any_rate"),
        F.count_if(several).alias("n_multi_source"),
        share(several).alias("multi_source_rate"),
        share((F.col("origin") != 0) & (F.col("input_id") == UNK)).alias("dropped_rate"),
    )


def marginal_difficulty(
    masked: DataFrame, train_tokens: DataFrame, bundle: Bundle, top_k: int = 5
) -> DataFrame:
    """How well the per-key value frequencies of the training tokens predict the masked values:
    mean cross-entropy and top-1 / top-k hit rate by source and key.

    Add-one smoothing over the values seen for the key plus one unseen value. The frequency
    table has one row per (key, value) of the vocabulary, not per token.
    """
    seen = materialize(train_tokens.groupBy("key_id", "value_id").agg(F.count(F.lit(1)).alias("n")), "seen-values")
    per_key = seen.groupBy("key_id").agg(
        F.sum("n").alias("n_key"), F.count(F.lit(1)).alias("n_values")
    )
    # Only the first top_k places matter: Spark keeps that many rows per key before the shuffle.
    place = Window.partitionBy("key_id").orderBy(F.desc("n"), "value_id")
    top = (
        seen.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top_k)
        .select("key_id", "value_id", "place")
    )
    size = bundle.max_pairs
    targets = masked.where(F.col("label") != NO_LABEL)
    joined = (
        targets.join(broadcast_if_small(seen, size), ["key_id", "value_id"], "left")
        .join(broadcast_if_small(per_key, len(bundle.key_ids)), "key_id", "left")
        .join(broadcast_if_small(top, len(bundle.key_ids) * top_k), ["key_id", "value_id"], "left")
    )
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("n_key", F.lit(0)) + F.coalesce("n_values", F.lit(0)) + 1)
    sources = F.array(
        *[F.when(F.col("origin").bitwiseAND(b) != 0, F.lit(s)) for s, b in SOURCES.items()], F.lit("any")
    )
    return (
        joined.select("key_id", F.explode(sources).alias("source"), (-F.log(p)).alias("loss"), "place")
        .where("source is not null").groupBy("source", "key_id")
        .agg(
            F.count(F.lit(1)).alias("n_masked"),
            F.avg("loss").alias("cross_entropy"),
            F.avg(F.when(F.col("place") == 1, 1.0).otherwise(0.0)).alias("top1_rate"),
            F.avg(F.when(F.col("place").isNotNull(), 1.0).otherwise(0.0)).alias("topk_rate"),
        )
    )

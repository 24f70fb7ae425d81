"""Hash split by entity and fingerprints of id sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.hashing import hex_word

# 65,536 branches: below two million ids each up to 10^11 ids.
DEPTH = 4


@dataclass(frozen=True)
class SplitConfig:
    # Default fractions and seed.
    train_frac: float = 0.8
    val_frac: float = 0.1
    seed: int = 20260101

    def __post_init__(self) -> None:
        if not 0 < self.train_frac < 1 or not 0 <= self.val_frac < 1:
            raise ValueError("split fractions must lie in (0, 1)")
        if self.train_frac + self.val_frac >= 1:
            raise ValueError("train and val must leave room for a test split")


def split_of(entity_id: Column, config: SplitConfig = SplitConfig()) -> Column:
    """train, val or test from a hash of the id: row-local, independent of any order."""
    hashed = F.sha2(F.concat(F.lit(f"{config.seed}:"), entity_id), 256)
    place = hex_word(hashed) / F.lit(4294967295.0)
    return (
        F.when(place < config.train_frac, "train")
        .when(place < config.train_frac + config.val_frac, "val")
        .otherwise("test")
    )


def split_audit(records: DataFrame) -> DataFrame:
    """One row: entities, entities without a split, entities in more than one split."""
    per_entity = records.groupBy("entity_id").agg(
        F.countDistinct("split").alias("n"), F.count_if(F.col("split").isNull()).alias("missing")
    )
    return per_entity.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(F.col("missing") > 0).alias("n_without_split"),
        F.count_if(F.col("n") > 1).alias("n_in_two_splits"),
    )


def tree_fingerprint(ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """One hash of a set of ids, independent of their order and number of partitions.

    Ids are grouped by the first ``DEPTH`` hex digits of their own hash, each branch is hashed in
    sorted order, and the branch hashes are folded sixteen at a time up to the root. The depth is
    fixed, so a set has one fingerprint whatever its size.
    """
    level = ids.select(F.sha2(key, 256).alias("place"), F.col(key).alias("item"))
    for width in range(DEPTH, -1, -1):
        level = (
            level.groupBy(F.substring("place", 1, width).alias("place"))
            .agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("item"))), 256).alias("item"))
        )
    return level.select(F.col("item").alias("fingerprint"))

"""Mixture-true shards by proportional stratified interleaving.

Rows are put in a seeded random order inside each source, every row gets its fractional rank
(rank + 1/2) / rows of the source, and one sort by that fraction interleaves the sources in
proportion. Cutting this order into runs of equal length gives shards that each hold the mixture
of the whole table, to about one row per source.

Both orders are cut into slices (of the hash, then of the fraction), so neither a source with a
third of all rows nor the whole table is one task. The number of slices only decides the balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import hash_slice, prefix_sums, slices_for
from eventlens.session import materialize

SEED = 20_240


def interleave(
    docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """Add ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 inside the shard).

    The other columns are kept; input columns named ``shard`` or ``slot`` are replaced. Shard sizes
    differ by one row at most. A null source is a source of its own, a null id is an id like any
    other. Repeated rows each get a place; rows that agree in every column are interchangeable, so
    the result does not depend on how the input was partitioned. An empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    named = {c: f"__c{i}" for i, c in enumerate(kept)}
    src, doc = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    spread = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in named.items()],
        F.coalesce(F.concat(F.lit("="), src), F.lit("")).alias("__stratum"),
        # rows that share an id are told apart by all their columns, also where the order is cut into slices
        F.xxhash64(F.lit(seed), doc, *[F.col(f"`{c}`") for c in kept]).alias("__h"),
        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in kept]).alias("__tie"),
    )
    rows = materialize(spread, "interleave-rows")
    n = rows.count()
    slices = slices_for(n)
    sliced = rows.withColumn("__slice", hash_slice(F.col("__h"), slices))
    ranked = prefix_sums(sliced, ["__stratum"], "__slice", ["__h", "__tie"], F.lit(1), "__rank")
    sizes = rows.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__n"))
    fraction = (F.col("__rank") * 2 + 1) / (F.col("__n") * 2)
    placed = materialize(
        ranked.drop("__slice").join(sizes, "__stratum")
        .withColumn("__f", fraction)
        .withColumn("__slice", F.floor(F.col("__f") * slices).cast("int"))
        .withColumn("__s", F.xxhash64(F.lit(seed + 1), "__stratum")),
        "interleave-fractions",
    )
    ordered = prefix_sums(placed, [], "__slice", ["__f", "__s", "__stratum"], F.lit(1), "__pos")
    n = max(n, 1)
    return ordered.withColumn("shard", F.expr(f"(__pos * {n_shards}L) div {n}L").cast("int")).select(
        *[F.col(t).alias(c) for c, t in named.items()],
        "shard",
        F.expr(f"__pos - (shard * {n}L + {n_shards - 1}L) div {n_shards}L").cast("bigint").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order; each shard is one sorted run."""
    n = sharded.agg(F.max("shard")).first()[0]
    (
        sharded.repartitionByRange((n or 0) + 1, "shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )

"""Tokenised records as partitioned Parquet with a verified manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.buckets import LENGTH_EDGES, length_label
from eventlens.operators.encode import SHARD_TYPES

SCHEMA_VERSION = 1
RECORDS_PER_FILE = 20_000
# A file up to this size is hashed as one row; a larger one is held against its blocks.
WHOLE_FILE_BYTES = 256 << 20
RECORDS_PER_BLOCK = 1024

RECORD_SCHEMA = ", ".join(f"{n} {t}" for n, t in SHARD_TYPES.items())
SHARD_SCHEMA = (
    ", ".join(f"{n} {t}" for n, t in SHARD_TYPES.items() if n != "split")
    + ", split string, length_bucket string"
)
BLOCK_SCHEMA = "path string, block bigint, n_records bigint, content_hash bigint"
MANIFEST_SCHEMA = (
    "schema_version int, processor_train_fingerprint string, created_at string, path string, "
    "split string, length_bucket string, n_records bigint, n_events bigint, n_value_tokens bigint, "
    "sha256 string, content_hash bigint"
)


def _shard_counts() -> list:
    tokens = F.size("profile_value_ids") + F.aggregate(
        "event_value_ids", F.lit(0), lambda a, ids: a + F.size(ids)
    )
    return [
        F.count(F.lit(1)).alias("n_records"),
        F.sum("n_events_kept").alias("n_events"),
        F.sum(tokens).cast("bigint").alias("n_value_tokens"),
    ]


def shard_totals(shards: DataFrame, edges=LENGTH_EDGES) -> DataFrame:
    """Records, events and tokens per (split, length bucket)."""
    bucketed = shards.withColumn("length_bucket", length_label(F.col("n_events_kept"), edges))
    return bucketed.groupBy("split", "length_bucket").agg(*_shard_counts())


def write_shards(
    records: DataFrame,
    path: str,
    *,
    fingerprint: str | None = None,
    edges=LENGTH_EDGES,
    records_per_file: int = RECORDS_PER_FILE,
) -> DataFrame:
    """Write one folder per (split, length bucket), a manifest with one row per file, and the content
    hashes of runs of records in each file.

    The rebalance hint sizes the writing tasks by bytes: a group with most of the records is
    split over many tasks, small groups share one.
    """
    bucketed = records.withColumn("length_bucket", length_label(F.col("n_events_kept"), edges))
    (
        bucketed.hint("rebalance", "split", "length_bucket")
        .write.mode("error").option("maxRecordsPerFile", records_per_file)
        .partitionBy("split", "length_bucket").parquet(f"{path}/records")
    )
    spark = records.sparkSession
    block_hashes(spark, path).write.mode("error").parquet(f"{path}/blocks")
    manifest = build_manifest(spark, path, fingerprint)
    manifest.coalesce(1).write.mode("error").json(f"{path}/manifest")
    return read_manifest(spark, path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/records")


def _relative(col: Column) -> Column:
    return F.substring_index(col, "/records/", -1)


def file_hashes(spark: SparkSession, path: str, split: str | None = None, whole_bytes: int | None = None) -> DataFrame:
    """``(path, sha256)`` of the data files, read in parallel as whole files; null for a file too large for one row."""
    folder = f"{path}/records" if split is None else f"{path}/records/split={split}"
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true").load(folder)
    )
    limit = WHOLE_FILE_BYTES if whole_bytes is None else whole_bytes
    small = files.where(F.col("length") <= limit).select("path", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > limit).select("path", F.lit(None).cast("string").alias("sha256"))
    return small.unionByName(large).withColumn("path", _relative(F.col("path")))


def block_hashes(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """``(path, block, n_records, content_hash)``: order-free hashes of runs of records of each file.

    Files are read in splits, so no file is one row or one task. What the reader cannot decode is left
    out: its records are missing from their blocks. Damage that shows only in a value's use stops the job.
    """
    shards = spark.read.schema(SHARD_SCHEMA).option("ignoreCorruptFiles", "true").parquet(f"{path}/records")
    if split is not None:
        shards = shards.where(F.col("split") == split)
    place = shards.withColumn("path", _relative(F.col("_metadata.file_path"))).withColumn(
        "block", F.floor(F.col("_metadata.row_index") / RECORDS_PER_BLOCK)
    )
    return place.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n_records"), F.bit_xor(F.xxhash64(*[F.col(n) for n in SHARD_TYPES])).alias("content_hash")
    )


def block_mismatches(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """``(path, block)`` of the runs of records that are not as they were written."""
    stated = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    if split is not None:
        stated = stated.where(F.col("path").startswith(f"split={split}/"))
    actual = block_hashes(spark, path, split)
    both = stated.withColumnsRenamed({"n_records": "n", "content_hash": "h"}).join(actual, ["path", "block"], "full")
    return both.where(~F.col("n").eqNullSafe(F.col("n_records")) | ~F.col("h").eqNullSafe(F.col("content_hash"))).select("path", "block")


def build_manifest(spark: SparkSession, path: str, fingerprint: str | None) -> DataFrame:
    shards = _files(spark, path)
    values = [F.col(n) for n in SHARD_TYPES]
    per_file = (
        shards.withColumn("path", _relative(F.col("_metadata.file_path")))
        .groupBy("path", "split", "length_bucket")
        .agg(*_shard_counts(), F.bit_xor(F.xxhash64(*values)).alias("content_hash"))
    )
    return per_file.join(file_hashes(spark, path), "path").select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(fingerprint).cast("string").alias("processor_train_fingerprint"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        "path", "split", "length_bucket", "n_records", "n_events", "n_value_tokens", "sha256",
        "content_hash",
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")


def checksum_mismatches(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Files whose bytes differ from the manifest, or that are missing, or not listed."""
    stated = read_manifest(spark, path).select("path", F.col("sha256").alias("stated"), "split")
    if split is not None:
        stated = stated.where(F.col("split") == split)
    actual = file_hashes(spark, path, split)
    return stated.drop("split").join(actual, "path", "full").where(
        ~F.col("stated").eqNullSafe(F.col("sha256"))
    )


def read_shards(
    spark: SparkSession, path: str, split: str | None = None, *, verify: bool | str = True
) -> DataFrame:
    """Stored records; a split filter prunes folders. A changed file stops the read.

    Files are held against their checksums, those too large for one row against the content hashes of
    their blocks; ``verify="content"`` checks all blocks instead, and an error names the first one that differs.
    """
    if verify and verify != "content":
        bad = checksum_mismatches(spark, path, split).orderBy("path").first()
        if bad is not None:
            raise ValueError(f"checksum mismatch for shard '{bad['path']}'")
        unhashed = read_manifest(spark, path).where("sha256 is null").select("path")
        changed = None if unhashed.isEmpty() else block_mismatches(spark, path, split).join(unhashed, "path", "left_semi")
    else:
        changed = block_mismatches(spark, path, split) if verify else None
    bad = None if changed is None else changed.orderBy("path", "block").first()
    if bad is not None:
        raise ValueError(f"content of shard '{bad['path']}' differs in block {bad['block']}")
    shards = _files(spark, path).select(*SHARD_TYPES, "length_bucket")
    return shards if split is None else shards.where(F.col("split") == split)


def to_json(shards: DataFrame) -> DataFrame:
    return shards.select("entity_id", F.to_json(F.struct(*SHARD_TYPES)).alias("record"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("record", RECORD_SCHEMA).alias("r")).select("r.*")

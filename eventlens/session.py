"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

AUTO_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def utc_session(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every clock feature is defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session that names none uses its warehouse folder; on a cluster a missing name is an
    error, as a folder of one machine would lose the other executors' files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    named = named or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/eventlens/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    Used where several later steps need the same intermediate: the upstream work
    runs once, and the table outlives any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like ``materialize``, in buckets of ``key``: what is grouped or joined by it later is read in place.

    As many buckets as there are shuffle partitions, so that rows which meet a bucketed table travel alone.
    """
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex}"
    table = "eventlens_" + name.replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/eventlens/{name}")
    before = {name: spark.conf.get(name) for name in (AUTO_SCAN, OPEN_FILES)}
    spark.conf.set(AUTO_SCAN, "false")  # what is read by bucket is written by bucket, one file for each
    spark.conf.set(OPEN_FILES, "4")  # so a task's rows are not sorted by bucket first: they are of one bucket, or few
    try:
        writer.bucketBy(buckets, key).saveAsTable(table)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.table(table)

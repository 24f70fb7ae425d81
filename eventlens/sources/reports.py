"""Small result tables as CSV or JSON, and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_report(report: DataFrame, path: str, kind: str = "csv") -> None:
    """One file per report; reports have a row per model or metric, not per record."""
    writer = report.coalesce(1).write.mode("error")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError("kind must be 'csv' or 'json'")


def read_report(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("error").parquet(path)


def read_embeddings(spark: SparkSession, *paths: str) -> DataFrame:
    """Several embedding tables stacked by column name."""
    out = None
    for path in paths:
        df = spark.read.parquet(path)
        out = df if out is None else out.unionByName(df)
    return out

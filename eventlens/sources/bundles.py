"""Saving, loading and comparing fitted bundles."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import registry as R
from eventlens.operators.bundle import SCHEMA_VERSION, Bundle, EncoderConfig
from eventlens.operators.split import tree_fingerprint


def bundle_tables(bundle: Bundle, spark: SparkSession) -> dict[str, DataFrame]:
    bounds = [
        (k, i, float(b)) for k, bs in bundle.numeric_bounds.items() for i, b in enumerate(bs)
    ]
    merges = [(i, *m) for i, m in enumerate(bundle.merges)]
    return {
        "keys": spark.createDataFrame(list(bundle.key_ids.items()), "key string, key_id int"),
        "numeric_bounds": spark.createDataFrame(bounds, "key string, idx int, bound double"),
        "categories": bundle.categories.select("key", "value", "value_id"),
        "merges": spark.createDataFrame(merges, "rank int, left_id int, right_id int, new_id int"),
    }


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    for name, df in bundle_tables(bundle, spark).items():
        df.write.mode("error").parquet(f"{path}/{name}")
    meta = {
        "schema_version": SCHEMA_VERSION,
        "config": asdict(bundle.config),
        "numeric_keys": list(bundle.numeric_bounds),
        "n_categories": bundle.n_categories,
        "text_base": bundle.text_base,
        "train_fingerprint": bundle.train_fingerprint,
        "n_train_records": bundle.n_train_records,
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("error").text(
        f"{path}/meta"
    )


def load_bundle(spark: SparkSession, path: str, registry: R.Registry) -> Bundle:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["schema_version"] != SCHEMA_VERSION:
        raise ValueError(
            f"bundle has schema version {meta['schema_version']}, this code reads {SCHEMA_VERSION}"
        )
    config = meta["config"]
    config["fit_scopes"] = tuple(config["fit_scopes"])
    bounds: dict[str, list[float]] = {k: [] for k in meta["numeric_keys"]}
    for r in spark.read.parquet(f"{path}/numeric_bounds").orderBy("key", "idx").collect():
        bounds[r["key"]].append(r["bound"])
    merges = [
        (r["left_id"], r["right_id"], r["new_id"])
        for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    ]
    return Bundle(
        registry, EncoderConfig(**config), bounds, spark.read.parquet(f"{path}/categories"),
        meta["n_categories"], merges, True, meta["train_fingerprint"], meta["n_train_records"],
    )


def bundle_rows(bundle: Bundle, spark: SparkSession) -> DataFrame:
    """Every fact of the bundle as one line of text."""
    lines = None
    for name, df in bundle_tables(bundle, spark).items():
        part = df.select(
            F.concat_ws("|", F.lit(name), *[F.col(c).cast("string") for c in df.columns]).alias("line")
        )
        lines = part if lines is None else lines.unionByName(part)
    settings = spark.createDataFrame([("config|" + json.dumps(asdict(bundle.config)),)], "line string")
    return lines.unionByName(settings)


def bundle_hash(bundle: Bundle, spark: SparkSession) -> str:
    """Hash over the facts, whatever files hold them; built in levels."""
    return tree_fingerprint(bundle_rows(bundle, spark), "line").first()["fingerprint"]


def require_same_bundle(bundle: Bundle, spark: SparkSession, expected: str) -> None:
    actual = bundle_hash(bundle, spark)
    if actual != expected:
        raise ValueError(f"encoder bundle does not match: expected {expected}, got {actual}")

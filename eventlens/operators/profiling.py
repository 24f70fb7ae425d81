"""Describing tables: shares, summaries per group, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators.ordered import quantiles

QUARTILES = (0.25, 0.5, 0.75)


def shares(df: DataFrame, col: str) -> DataFrame:
    """``(col, n, share)``. The total is taken over the few counted groups, not the rows."""
    from pyspark.sql import Window

    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def describe(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per group and column."""
    by = list(by)
    slots = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    long = df.select(*by, F.explode(slots).alias("s")).select(*by, "s.*")
    stats = long.groupBy(*by, "column").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    q = quantiles(long, [*by, "column"], "v", QUARTILES)
    wide = q.groupBy(*by, "column").agg(
        *[F.max(F.when(F.col("idx") == i, F.col("quantile"))).alias(f"p{int(f * 100)}")
          for i, f in enumerate(QUARTILES)]
    )
    return stats.join(wide, [*by, "column"], "left")


def histogram(df: DataFrame, by: str, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the least and largest value of each group:
    ``(by, bin, low, high, n)``, empty bins included. The last bin takes its upper edge."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy(by).agg(
        F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    placed = counts.join(edges, by).withColumn(
        "bin",
        F.when(F.col("hi") == F.col("lo"), 0).otherwise(
            F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))
        ).cast("int"),
    )
    filled = placed.groupBy(by, "bin").agg(F.sum("n").alias("n"))
    grid = edges.select(by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(filled, [by, "bin"], "left").select(
        by, "bin",
        (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )

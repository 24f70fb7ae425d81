"""Running totals, ranks and exact quantiles over groups of any size.

A window over a whole group puts the group into one task. That is right for most
groups and wrong for one that holds a third of the data (or for "the whole table").
Rows of such heavy groups, and only they, leave the stream: they are range-partitioned by
(group, order), so a large group lies in many partitions; every (group, partition) is a
window of its own, and what the group's earlier partitions add up to comes from a small table.
The partitions follow the rows; where they are cut does not change the result. The newest rows of
a heavy group are found by a tree instead: first among a share of its rows each, then among the winners.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.buckets import bucket_index
from eventlens.operators.skew import HeavyGroups, split_heavy
from eventlens.session import materialize

ROWS_PER_TASK = 2_000_000
# Longer lists of heavy groups stay a table.
LISTED_GROUPS = 10_000


def heavy_groups(
    df: DataFrame, by: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> Sequence[tuple]:
    """Groups with more rows than one task should take: ``(*key values, rows)``, largest first.

    There are at most rows / ``rows_per_task`` of them.
    """
    if not by:
        n = df.count()
        return [(n,)] if n > rows_per_task else []
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > rows_per_task)
    found = counts.orderBy(F.desc("rows"), *by).limit(LISTED_GROUPS + 1).collect()
    if len(found) <= LISTED_GROUPS:
        return [tuple(r) for r in found]
    table = materialize(counts, "heavy-groups")
    return HeavyGroups(table, table.count())


def _sorted(cols: Sequence[str], newest_first: bool) -> list[Column]:
    return [F.col(c).desc() if newest_first else F.col(c).asc() for c in cols]


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    *,
    maxima: Mapping[str, Column] | None = None,
    newest_first: bool = False,
    heavy: Sequence[tuple] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add inclusive running sums of ``totals`` and running maxima of ``maxima`` per group, rows in
    the given order.

    ``order`` must be free of nulls and make rows unique inside a group. ``heavy`` is the
    result of ``heavy_groups``, for callers that know it already.
    """
    by, order = list(by), list(order)
    maxima = dict(maxima or {})
    states = [(n, F.sum, c) for n, c in totals.items()] + [(n, F.max, c) for n, c in maxima.items()]
    if heavy is None:
        heavy = heavy_groups(df, by, rows_per_task)

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*_sorted(order, newest_first)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[step(c).over(w).alias(name) for name, step, c in states])

    if not heavy:
        return plain(df)
    hot, cold = split_heavy(df, by, heavy) if by else (df, None)
    stored = materialize(hot, "heavy-rows")
    parts = max(2, math.ceil(stored.count() / rows_per_task))
    cut = materialize(
        stored.repartitionByRange(parts, *by, *order).withColumn("slice", F.spark_partition_id()), "ordered-slices"
    )
    w = (
        Window.partitionBy(*by, "slice").orderBy(*_sorted(order, newest_first))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = cut.select("*", *[step(c).over(w).alias(name) for name, step, c in states])
    per_slice = cut.groupBy(*by, "slice").agg(*[step(c).alias(f"all_{name}") for name, step, c in states])
    before = (
        Window.partitionBy(*by).orderBy(*_sorted(["slice"], newest_first)).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_slice.select(
        *by, "slice", *[step(f"all_{name}").over(before).alias(f"before_{name}") for name, step, _ in states]
    )
    joined = local.join(offsets, [*by, "slice"], "left")
    sliced = joined.select(
        *df.columns,
        *[(F.col(n) + F.coalesce(F.col(f"before_{n}"), F.lit(0))).alias(n) for n in totals],
        *[F.greatest(n, f"before_{n}").alias(n) for n in maxima],
    )
    return sliced if cold is None else plain(cold).unionByName(sliced)


def ranks(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    newest_first: bool = False,
    heavy: Sequence[tuple] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the 1-based row number inside each group."""
    if heavy is None:
        heavy = heavy_groups(df, by, rows_per_task)
    if not heavy:
        w = Window.partitionBy(*by).orderBy(*_sorted(order, newest_first))
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    return running_totals(
        df, by, order, {name: F.lit(1).cast("bigint")},
        newest_first=newest_first, heavy=heavy, rows_per_task=rows_per_task,
    )


def first_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    n: int,
    name: str,
    *,
    newest_first: bool = False,
    heavy: Sequence[tuple] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The first ``n`` rows of each group, with their 1-based row number.

    A heavy group's rows compete in shares first; the winners of as many shares as one task takes
    compete again, until one share is left. Nothing is written, and each row of a heavy group is read
    and sorted once more than the others.
    """
    by, order = list(by), list(order)
    if heavy is None:
        heavy = heavy_groups(df, by, rows_per_task)

    def best(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*_sorted(order, newest_first))
        return rows.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= n)

    if not heavy:
        return best(df, by)
    hot, cold = split_heavy(df, by, heavy) if by else (df, None)
    shares = math.ceil(heavy[0][-1] / rows_per_task)
    hot = hot.withColumn("__share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    while shares > 1:
        together = max(2, rows_per_task // n)
        hot = best(hot, [*by, "__share"]).drop(name).withColumn("__share", F.floor(F.col("__share") / together))
        shares = math.ceil(shares / together)
    won = best(hot.drop("__share"), by)
    return won if cold is None else best(cold, by).unionByName(won)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts: combined before the shuffle."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles_of_counts(
    counts: DataFrame,
    by: Sequence[str],
    value: str,
    fractions: Sequence[float],
    *,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact quantiles out of ``value_counts``: ``(*by, idx, fraction, quantile)``.

    Linear interpolation between the two neighbours in rank. No group is gathered: the
    counts get a running total, and each wanted rank is met by the row that covers it.
    """
    by = list(by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n_all"))
    cum = running_totals(counts, by, [value], {"upto": F.col("n")}, rows_per_task=rows_per_task)
    if by:
        cum = cum.join(totals, by)
    else:
        cum = cum.withColumn("n_all", F.lit(totals.first()["n_all"]).cast("bigint"))
    # Few rows cover a wanted rank. The first fraction above the row's share of the ranks (one
    # rank wider on each side) picks them out, and only they are compared with the ranks.
    first = F.col("upto") - F.col("n")
    steps = F.greatest(F.col("n_all") - 1, F.lit(1))
    marks = sorted(float(f) for f in fractions)
    following = F.element_at(
        F.array(*[F.lit(m) for m in [*marks, math.inf]]), bucket_index((first - 2) / steps, marks) + 1
    )
    near = cum.where(following <= (F.col("upto") + 1) / steps)
    spots = F.transform(
        F.array(*[F.lit(float(f)) for f in fractions]),
        lambda f, i: F.struct(i.alias("idx"), f.alias("fraction"), (f * (F.col("n_all") - 1)).alias("spot")),
    )
    ends_of = F.transform(
        spots,
        lambda s: F.struct(
            s["idx"].alias("idx"),
            s["fraction"].alias("fraction"),
            F.floor(s["spot"]).alias("low"),
            F.least(F.floor(s["spot"]) + 1, F.col("n_all") - 1).alias("high"),
            (s["spot"] - F.floor(s["spot"])).alias("t"),
        ),
    )
    rows = near.select(
        *by, F.col(value).alias("v"), first.alias("first"), "upto", F.explode(ends_of).alias("w")
    )
    at_low = (F.col("first") <= F.col("w.low")) & (F.col("w.low") < F.col("upto"))
    at_high = (F.col("first") <= F.col("w.high")) & (F.col("w.high") < F.col("upto"))
    ends = rows.where(at_low | at_high).groupBy(*by, "w.idx", "w.fraction").agg(
        F.max(F.when(at_low, F.col("v"))).alias("low"),
        F.max(F.when(at_high, F.col("v"))).alias("high"),
        F.max("w.t").alias("t"),
    )
    return ends.select(*by, "idx", "fraction", lerp(F.col("low"), F.col("high"), F.col("t")).alias("quantile"))


def lerp(low: Column, high: Column, t: Column) -> Column:
    """Interpolation that is exact at both ends."""
    span = high - low
    return F.when(t < 0.5, low + span * t).otherwise(high - span * (1 - t))


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], **kw
) -> DataFrame:
    """Exact quantiles of a column. The counts are written once, as three steps read them."""
    counts = materialize(value_counts(df, by, value), "value-counts")
    return quantiles_of_counts(counts, by, value, fractions, **kw)


def value_at_ranks(
    df: DataFrame, order: Sequence[str], wanted: Sequence[int], **kw
) -> list[tuple]:
    """The rows' order values at the given 1-based ranks of the whole table, on the driver.

    As many tuples as ranks asked for. Lets a table be cut into equal parts by comparing
    each row with a few cut tuples, so that no sort of the whole table is needed downstream.
    """
    ranked = ranks(df.select(*order), [], order, "rank", **kw)
    rows = ranked.where(F.col("rank").isin([int(w) for w in wanted])).collect()
    return [tuple(r[c] for c in order) for r in sorted(rows, key=lambda r: r["rank"])]


def part_of(order: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """Number of cut tuples that are <= the row (compared column by column)."""

    def at_least(cut: tuple) -> Column:
        out = F.lit(True)
        for name, v in reversed(list(zip(order, cut))):
            out = (F.col(name) > F.lit(v)) | ((F.col(name) == F.lit(v)) & out)
        return out

    total = F.lit(0)
    for cut in cuts:
        total = total + at_least(cut).cast("int")
    return total

"""Heavy groups: what is known of them, and joins of a large table with a one-row-per-entity table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.session import materialize

BROADCAST_ROWS = 100_000


class HeavyGroups(Sequence):
    """Heavy groups that are too many for the driver: ``(*key values, rows)``, largest first, in a written table."""

    def __init__(self, table: DataFrame, n: int):
        self.table, self.n = table, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return tuple(self.table.orderBy(F.desc("rows"), *self.table.columns[:-1]).limit(i + 1).tail(1)[0])


def broadcast_if_small(df: DataFrame, n_rows: int) -> DataFrame:
    """Hint a broadcast only for a side whose row count is known to be small."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def heavy_table(df: DataFrame, by: Sequence[str], heavy: Sequence[tuple]) -> DataFrame:
    if isinstance(heavy, HeavyGroups):
        return heavy.table.select(*by)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in by])
    return df.sparkSession.createDataFrame([h[:-1] for h in heavy], schema)


def split_heavy(df: DataFrame, by: Sequence[str], heavy: Sequence[tuple]) -> tuple[DataFrame, DataFrame]:
    """The rows of heavy groups, and the others. Each is read from where ``df`` reads; a plan that may
    give other rows the second time is written first."""
    if not df._jdf.queryExecution().analyzed().deterministic():
        df = materialize(df, "ordered-input")
    hot = broadcast_if_small(heavy_table(df, by, heavy), len(heavy))
    return df.join(hot, list(by), "left_semi"), df.join(hot, list(by), "left_anti")


def join_per_entity(
    rows: DataFrame,
    per_entity: DataFrame,
    how: str,
    heavy: Sequence[tuple],
    *,
    key: str = "entity_id",
) -> DataFrame:
    """Join ``rows`` with a table that has one row per ``key``.

    Without heavy entities this is a plain join. Otherwise the heavy entities go through a
    broadcast of just their rows, as long as these are few, and only the rest is shuffled.
    """
    if not heavy:
        return rows.join(per_entity, key, how)
    hot = broadcast_if_small(heavy_table(rows, [key], heavy), len(heavy))
    hot_side = broadcast_if_small(per_entity.join(hot, key, "left_semi"), len(heavy))
    hot_rows = rows.join(hot, key, "left_semi").join(hot_side, key, how)
    cold_rows = rows.join(hot, key, "left_anti").join(per_entity, key, how)
    return hot_rows.unionByName(cold_rows)

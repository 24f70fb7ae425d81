"""Named queries with the SQL that must give the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.plans.reference_sql import with_ctes
from eventlens.plans.workspace import Workspace

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Workspace], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function name."""

    def register(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query '{fn.__name__}' is already registered")
        QUERIES[fn.__name__] = Query(fn.__name__, fn, with_ctes(sql) if sql else None)
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """The result in types that any engine compares alike: whole numbers as bigint, instants as
    microseconds, fractions rounded, lists of whole numbers as text."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            col = col.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            col = F.unix_micros(col)
        elif isinstance(f.dataType, T.DecimalType | T.DoubleType | T.FloatType):
            rounded = F.round(col.cast("double"), DIGITS)
            col = F.when(rounded == 0.0, 0.0).otherwise(rounded)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType):
            col = F.array_join(F.transform(col, lambda a: F.array_join(a.cast("array<string>"), ",")), ";")
        elif isinstance(f.dataType, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), ",")
        cols.append(col.alias(f.name))
    return df.select(*cols)

"""How raw values read as categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_of_boolean(col: Column) -> Column:
    """Booleans as categories read ``True`` and ``False``."""
    return F.when(col, F.lit("True")).when(~col, F.lit("False"))


def as_category(df: DataFrame, name: str) -> Column:
    """The column's text form, the same wherever a category is learned or looked up."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return text_of_boolean(F.col(name))
    return F.col(name).cast("string")

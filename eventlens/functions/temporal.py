"""Clock features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SOFT_LOG_SCALE = 8.0
CALENDAR = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "dom_sin", "dom_cos")


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def soft_log(seconds: Column, scale: float = SOFT_LOG_SCALE) -> Column:
    """``scale * ln(1 + t/scale)``. A negative time is a leak, so the job stops."""
    value = F.lit(scale) * F.log1p(seconds / F.lit(scale))
    return F.when(
        seconds < 0, F.raise_error(F.lit("elapsed time is negative: event after its reference"))
    ).otherwise(value)


def calendar(ts: Column) -> dict[str, Column]:
    """Sine and cosine of the hour, the weekday (Monday is 0) and the day of month."""
    turns = {
        "hour": F.hour(ts) / F.lit(24.0),
        "dow": F.weekday(ts) / F.lit(7.0),
        "dom": (F.dayofmonth(ts) - 1) / F.lit(31.0),
    }
    out: dict[str, Column] = {}
    for name, turn in turns.items():
        angle = F.lit(2 * math.pi) * turn
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out

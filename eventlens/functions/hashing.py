"""Stable hashes and hash-made uniforms, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str | int) -> Column:
    """SHA-256 hex of the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def hex_word(hex_digest: Column, word: int = 0) -> Column:
    """The ``word``-th group of eight hex digits as an integer in [0, 2^32)."""
    return F.conv(F.substring(hex_digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def uniform(hex_digest: Column, word: int = 0) -> Column:
    """Uniform number in [0, 1) out of one digest; several words give several draws."""
    return hex_word(hex_digest, word) / F.lit(4294967296.0)


def below(hex_digest: Column, p: float, word: int = 0) -> Column:
    """``uniform(hex_digest, word) < p`` without making the number: hex digits of one width compare like it."""
    least = math.ceil(p * 2**32)
    if not 0 < least < 2**32:
        return uniform(hex_digest, word) < p
    return F.substring(hex_digest, 1 + 8 * word, 8) < F.lit(f"{least:08x}")

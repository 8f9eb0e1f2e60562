"""Numeric helpers with the rounding and division rules the data model needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Half-even to six places, without negative zero."""
    return F.bround(c.cast("double"), 6) + F.lit(0.0)


def r9(c: Column) -> Column:
    """Half-even to nine places, without negative zero."""
    return F.bround(c.cast("double"), 9) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even_int(c: Column) -> Column:
    """Half-even rounding to an integer."""
    return F.bround(c.cast("double"), 0).cast("long")


def mod(a: Column, n: int) -> Column:
    """Remainder that is never negative."""
    return F.pmod(a, F.lit(n))


def seeded_hash(seed: int, *keys: Column) -> Column:
    """A 60-bit number fixed by the seed and the key's text, the same in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def seeded_share(seed: int, *keys: Column) -> Column:
    """``seeded_hash`` scaled to 0 <= x < 1 in millionths."""
    return (seeded_hash(seed, *keys) % 1_000_000) / 1e6

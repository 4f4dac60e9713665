"""Small scalar expressions: rounding, tolerant parsing, an order-preserving map of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """``floor(x * 10^digits + 0.5) / 10^digits``, which rounds negative halves up too."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + 0.5) / scale


def parse_or(x: Column, kind: str, otherwise) -> Column:
    """The text as ``kind``, or a given value where it is none."""
    return F.coalesce(x.try_cast(kind), F.lit(otherwise).cast(kind))


def isotone(x: Column, prefix: int = 3, other: int = -1) -> Column:
    """A number that grows with the first characters: digits and letters count 0 to 35, in base 256."""
    digits = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    total = F.lit(0).cast("long")
    for i in range(prefix):
        c = F.lower(F.substring(x, i + 1, 1))
        value = F.when(F.length(c) == 1, F.instr(digits, c) - 1).otherwise(other)
        total = total + value * 256 ** (prefix - i - 1)
    return total

"""Bit operations on 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lg_floor(x: Column) -> Column:
    """Floor of log2 of a positive integer, by its binary digits; null otherwise."""
    return F.when(x > 0, F.length(F.bin(x.cast("long"))) - 1)


def lg_ceil(x: Column) -> Column:
    return F.when(x > 0, lg_floor(x) + F.when(is_pow2(x), 0).otherwise(1))


def is_pow2(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x.cast("long")) == 1)


def floor_pow2(x: Column) -> Column:
    """The greatest power of two that isn't larger; 0 for what is below 1."""
    return F.when(x < 1, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), lg_floor(x)))


def ceil_pow2(x: Column) -> Column:
    """The least power of two that isn't smaller; 1 for what is below 1."""
    return F.when(x < 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), lg_ceil(x)))


def rotate_left(x: Column, by: int) -> Column:
    by %= 64
    x = x.cast("long")
    return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def rotate_right(x: Column, by: int) -> Column:
    return rotate_left(x, -by)


def reverse_bits(x: Column, width: int = 64) -> Column:
    """The lowest ``width`` bits in reverse order."""
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    digits = F.lpad(F.bin(x.cast("long").bitwiseAND(mask)), width, "0")
    # a leading 1 of 64 digits is the sign
    high = F.conv(F.substring(F.reverse(digits), 1, width - width // 2), 2, 10).cast("long")
    low = F.conv(F.substring(F.reverse(digits), width - width // 2 + 1, width // 2), 2, 10).cast("long")
    return F.shiftleft(high, width // 2).bitwiseOR(low)

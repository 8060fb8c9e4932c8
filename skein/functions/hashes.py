"""Hashes of keys with a fixed salt, for partitions, samples and sketches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted(key: Column, salt: int = 0) -> Column:
    """A 64-bit hash; another salt gives an independent one. The same in every run."""
    return F.xxhash64(key, F.lit(salt).cast("long"))


def identity(key: Column) -> Column:
    """The key itself as a hash, where keys are spread already."""
    return key.cast("long")


def bucket(key: Column, buckets: int, salt: int = 0) -> Column:
    return F.pmod(salted(key, salt), F.lit(buckets).cast("long"))


def unit(key: Column, salt: int = 0) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(salted(key, salt), 11).cast("double") * F.lit(2.0**-53)


def masked(key: Column, bits: int, salt: int = 0) -> Column:
    """The lowest bits of a hash."""
    return salted(key, salt).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

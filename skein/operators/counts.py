"""Counting: counters, merged counters, frequencies, shares, frecency, repeats and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.order import positions


def frequency(df: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def counter(df: DataFrame, key: str, amount: str, name: str = "cnt") -> DataFrame:
    """Sums of amounts by key, without the keys whose sum is zero."""
    return df.groupBy(key).agg(F.sum(amount).alias(name)).filter(F.col(name) != 0)


def merge(a: DataFrame, b: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    return counter(a.select(key, name).unionByName(b.select(key, name)), key, name, name)


def top_by_value(df: DataFrame, key: str, value: str, n: int = 10, least=None) -> DataFrame:
    """The ``n`` greatest values, of at least ``least``; equal values by the greater key first."""
    kept = df if least is None else df.filter(F.col(value) >= least)
    return kept.select(key, value).orderBy(F.col(value).desc(), F.col(key).desc()).limit(n)


def most_common(df: DataFrame, key: str, n: int = 10, name: str = "cnt") -> DataFrame:
    return top_by_value(frequency(df, key, name), key, name, n)


def top_k(df: DataFrame, key: str, k: int, ascending: bool = False) -> DataFrame:
    """The ``k`` greatest keys of a column, in either order."""
    top = df.select(key).orderBy(F.col(key).desc()).limit(k)
    return top.orderBy(F.col(key).asc()) if ascending else top


def top_in_groups(df: DataFrame, group: str, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` greatest values of each group; partitions keep ``n`` rows of a group before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(key).desc())
    return df.select(group, key, value, F.row_number().over(order).alias("place")).filter(F.col("place") <= n)


def line_frequency(lines: DataFrame, key: str = "line", n: int = 10) -> DataFrame:
    """Counts of lines: all if ``n`` is 0, the top ``n`` or ``|n|``, and none if ``n`` is -1."""
    counts = frequency(lines, key)
    if n == 0:
        return counts
    return counts.limit(0) if n == -1 else top_by_value(counts, key, "cnt", abs(n))


def summary(df: DataFrame, key: str) -> DataFrame:
    """How many distinct keys and how many in all, and the characters of the distinct ones."""
    counts = frequency(df, key)
    return counts.agg(
        F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_total"), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0)).alias("n_chars")
    )


def shares(counts: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    """Counts with their share of the grand total. The total is one row, joined to the counts."""
    total = counts.agg(F.sum(F.col(name).cast("double")).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(key, name, F.try_divide(F.col(name).cast("double"), F.col("_total")).alias("share"))


def frecency(df: DataFrame, key: str, order: list[str], old: float) -> DataFrame:
    """Sums of weights that fall by the factor ``old`` with each later record, and their shares: the latest weighs 1."""
    placed = positions(df.select(key, *[c for c in order if c != key]), order, "place")
    n = df.count()
    weights = placed.groupBy(key).agg(F.sum(F.pow(F.lit(float(old)), F.lit(float(n)) - F.col("place").cast("double"))).alias("weight"))
    return shares(weights, key, "weight")


def repeats(df: DataFrame, key: str, least: int) -> DataFrame:
    return frequency(df, key).filter(F.col("cnt") >= least)

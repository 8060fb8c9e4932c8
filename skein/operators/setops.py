"""Set and multiset algebra and comparisons over one key column. Comparisons return one row with one boolean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """A copy of the left side with the right side's keys that it lacks; the left side's duplicates stay."""
    key = a.columns[0]
    return a.union(b.toDF(key).distinct().join(a.distinct(), key, "left_anti"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One aggregation by key tells on which sides it is."""
    key = a.columns[0]
    both = a.select(F.col(key), F.lit(1).alias("side")).union(b.select(F.col(b.columns[0]), F.lit(2).alias("side")))
    return both.groupBy(key).agg(F.bit_or("side").alias("side")).filter("side <> 3").select(key)


def _counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each key's multiplicity on both sides, by one aggregation."""
    both = a.toDF("key").select("key", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.toDF("key").select("key", F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """disjoint, subset (multiplicities at most the right side's), proper (and fewer elements), equal."""
    n = _counts(a, b)
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    subset = every(F.col("x") <= F.col("y"))
    return n.agg(
        every((F.col("x") == 0) | (F.col("y") == 0)).alias("disjoint"),
        subset.alias("subset"),
        (subset & (F.coalesce(F.sum("x"), F.lit(0)) != F.coalesce(F.sum("y"), F.lit(0)))).alias("proper"),
        every(F.col("x") == F.col("y")).alias("equal"),
    )


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    return compare(a, b).select("disjoint")


def subset(a: DataFrame, b: DataFrame) -> DataFrame:
    return compare(a, b).select("subset")


def proper_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    return compare(a, b).select("proper")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    return compare(a, b).select("equal")


def equal_tables(a: DataFrame, b: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Whether each key has the same values in the same insertion order: rows of key, place and value are compared, no lists."""

    def placed(df: DataFrame, sign: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(order))
        return df.select(F.col(key).alias("key"), place.alias("place"), F.col(value).alias("value"), F.lit(sign).alias("sign"))

    left = placed(a, 1).unionByName(placed(b, -1)).groupBy("key", "place", "value").agg(F.sum("sign").alias("sign"))
    return left.agg(F.coalesce(F.bool_and(F.col("sign") == 0), F.lit(True)).alias("equal"))

"""Moments: population and sample, merged from parts, and over moving windows of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def basic(df: DataFrame, x: str, group: Sequence[str] = ()) -> DataFrame:
    """n, least, greatest, mean, population deviation; null where there is nothing."""
    return df.groupBy(*group).agg(
        F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sdev")
    )


def moments(df: DataFrame, x: str, group: Sequence[str] = ()) -> DataFrame:
    """Population moments; kurtosis is excess. One partial aggregation for all."""
    return df.groupBy(*group).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("sdev"),
        F.sqrt(F.var_pop(x) / F.count(x)).alias("stderror"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    )


def sample_moments(df: DataFrame, x: str, group: Sequence[str] = ()) -> DataFrame:
    """Sample-adjusted moments; 0 where there are too few values."""
    m = moments(df, x, group)
    n = F.col("n").cast("double")
    variance = F.when(n > 1, F.col("variance") * n / (n - 1)).otherwise(0.0)
    skew = F.when(n > 2, F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when(n > 3, (n - 1) * ((n + 1) * F.col("kurt") + 6) / ((n - 2) * (n - 3))).otherwise(0.0)
    return m.select(*group, "n", variance.alias("variance_s"), F.sqrt(variance).alias("sdev_s"), skew.alias("skew_s"), kurt.alias("kurt_s"))


def merge(parts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Basic statistics of the union, from those of its parts (n, least, greatest, mean, sdev)."""
    filled = parts.filter("n > 0")
    n = F.col("n").cast("double")
    # the parts' means, around the merged one: squares of large means would cancel
    means = filled.groupBy(*group).agg(F.try_divide(F.sum(n * F.col("mean")), F.sum("n").cast("double")).alias("_mean"))
    named = means.toDF(*(f"_g{k}" for k in range(len(group))), "_mean")
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    around = filled.join(named, same) if group else filled.crossJoin(named)
    off = F.col("mean") - F.col("_mean")
    sums = around.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.first("_mean").alias("_mean"),
        F.sum(n * F.col("sdev") * F.col("sdev")).alias("_v"), F.sum(n * off * off).alias("_q"), F.sum(n * off).alias("_s"),
    )
    shift = F.col("_s") / F.col("n")
    variance = (F.col("_v") + F.col("_q")) / F.col("n") - shift * shift
    return sums.filter("n > 0").select(*group, "n", "least", "greatest", (F.col("_mean") + shift).alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sdev"))


def normalized(df: DataFrame, x: str, group: Sequence[str], name: str = "share") -> DataFrame:
    """Values divided by their group's sum. The sums are aggregated and joined back, so that no task holds a group."""
    sums = df.groupBy(*group).agg(F.sum(F.col(x).cast("double")).alias("_sum"))
    share = F.try_divide(F.col(x).cast("double"), F.col("_sum"))
    if not group:
        return df.crossJoin(F.broadcast(sums)).withColumn(name, share).drop("_sum")
    named = sums.toDF(*(f"_g{k}" for k in range(len(group))), "_sum")
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]
    return df.join(named, same).withColumn(name, share).select(*df.columns, name)


def frame(series: Sequence[str], order: Sequence[str], win: int) -> WindowSpec:
    """The last ``win`` rows of a series, this one included."""
    return Window.partitionBy(*series).orderBy(*order).rowsBetween(1 - win, 0)


def moving(df: DataFrame, x: str, series: Sequence[str], order: Sequence[str], win: int) -> DataFrame:
    """Moments of the last ``win`` rows, extremes of them, and extremes since the series began."""
    over = frame(series, order, win)
    since = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    floor = lambda v, m: F.greatest(v, F.lit(1e-30) * m * m)
    mean: Column = F.avg(x).over(over)
    return df.select(
        "*", F.count(x).over(over).alias("n"), mean.alias("mean"), floor(F.var_pop(x).over(over), mean).alias("variance"), F.skewness(x).over(over).alias("skew"), F.kurtosis(x).over(over).alias("kurt"),
        F.min(x).over(over).alias("least"), F.max(x).over(over).alias("greatest"), F.min(x).over(since).alias("least_ever"), F.max(x).over(since).alias("greatest_ever"),
    )


def of_array(values: Column) -> dict[str, Column]:
    """n, mean, population deviation and extremes of an array column's numbers."""
    x = values.cast("array<double>")
    n = F.size(x).cast("double")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    mean = F.try_divide(total, n)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return {"n": F.size(x), "mean": mean, "sdev": F.sqrt(F.try_divide(square, n)), "least": F.array_min(x), "greatest": F.array_max(x)}

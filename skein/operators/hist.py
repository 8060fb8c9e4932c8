"""Histograms as (group..., bin, cnt) rows: counts, distribution functions and mid-rank quantiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.bins import Bins
from skein.operators.order import running_sum

Made = Callable[[Column], Column]


def histogram(df: DataFrame, bin_: Column, group: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Summed weights by bin; negative weights take away. Null bins are skipped, empty ones absent."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.withColumn("bin", bin_).filter("bin IS NOT NULL").groupBy(*group, "bin").agg(count.alias("cnt")).filter("cnt <> 0")


def merge(histograms: Sequence[DataFrame], bins: Sequence[Bins] = (), group: Sequence[str] = ()) -> DataFrame:
    """The sum of histograms; with ``bins`` given they must be the same."""
    if any(not bins[0].same(b) for b in bins):
        raise ValueError("histograms of different bins can't be merged")
    whole = histograms[0]
    for other in histograms[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy(*group, "bin").agg(F.sum("cnt").alias("cnt")).filter("cnt <> 0")


def distribution(hist: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """pmf and cdf as counts, npdf and ncdf as shares of the group. The windows hold bins, not rows of data."""
    inside = Window.partitionBy(*group)
    upto = inside.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("cnt").over(inside).cast("double")
    out = hist.withColumn("cdf", F.sum("cnt").over(upto)).withColumn("_t", total)
    return out.select(*group, "bin", F.col("cnt").alias("pmf"), "cdf", (F.col("cnt").cast("double") / F.col("_t")).alias("npdf"), (F.col("cdf").cast("double") / F.col("_t")).alias("ncdf"))


def inverse_cdf(hist: DataFrame, counts: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """For each count s in 1..total: the bin whose cumulative interval (s0, s1] holds it."""
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = hist.withColumn("s1", F.sum("cnt").over(upto)).withColumn("s0", F.col("s1") - F.col("cnt"))
    wanted = F.explode(F.array(*(F.lit(s).cast("long") for s in counts))).alias("s")
    return cumulative.select(*group, "bin", "s0", "s1", wanted).filter("s0 < s AND s <= s1").select(*group, "s", "bin", "s0", "s1")


def extremes(hist: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The least and greatest occupied bin."""
    return hist.filter("cnt > 0").groupBy(*group).agg(F.min("bin").alias("least"), F.max("bin").alias("greatest"))


def quantiles(hist: DataFrame, qs: Sequence[float], group: Sequence[str] = (), value: Made = lambda b: b) -> DataFrame:
    """Mid-rank quantiles by group: the value, interpolated over the middles of the bins' ranks, at q times the total.

    Below the first middle it is the least occupied bin's value, beyond the last the greatest's. ``value`` turns a bin
    into its value. A q outside of 0..1 gives NaN.
    """
    inside = Window.partitionBy(*group)
    order = inside.orderBy("bin")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.filter("cnt > 0").withColumn("_c", F.col("cnt").cast("double"))
    rows = rows.withColumn("_mid", F.sum("_c").over(upto) - F.col("_c") / F.lit(2.0)).withColumn("_total", F.sum("_c").over(inside)).withColumn("_v", value(F.col("bin")).cast("double"))
    rows = rows.withColumn("_mid1", F.lead("_mid").over(order)).withColumn("_v1", F.lead("_v").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    rows = rows.select("*", F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("q"))
    x = F.least(F.greatest(F.col("q"), F.lit(0.0)), F.lit(1.0)) * F.col("_total")
    below = F.col("_first") & (x < F.col("_mid"))
    inner = (F.col("_mid") <= x) & (F.col("_mid1").isNull() | (x < F.col("_mid1")))
    between = F.col("_v") + (F.col("_v1") - F.col("_v")) * (x - F.col("_mid")) / (F.col("_mid1") - F.col("_mid"))
    found = F.when(~F.col("q").between(0.0, 1.0), F.lit(float("nan"))).when(below | F.col("_mid1").isNull(), F.col("_v")).otherwise(between)
    return rows.filter(below | inner).select(*group, "q", found.alias("value"))


def binned_quantiles(df: DataFrame, x: Column, bins: Bins, qs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Mid-rank quantiles of binned values."""
    return quantiles(histogram(df, bins.index(x), group), qs, group, bins.value)


def count_upto(df: DataFrame, x: Column, bins: Bins, at: float, group: Sequence[str] = ()) -> DataFrame:
    """The raw count in the bins up to and with that of ``at``."""
    edge = bins.index(F.lit(float(at)))
    return histogram(df, bins.index(x), group).groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("bin") <= edge, F.col("cnt"))), F.lit(0)).alias("cdf"))


def underflow_overflow(df: DataFrame, x: Column, bins: Bins) -> DataFrame:
    """Counts of the lowest, the middle and the highest bin, and of all."""
    hist = histogram(df, bins.index(x))
    one = lambda b: F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("cnt"))), F.lit(0))
    return hist.agg(one(0).alias("underflows"), one(bins.n).alias("zeros"), one(2 * bins.n).alias("overflows"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def cumulative(df: DataFrame, order: str, value: str, name: str = "cumsum") -> DataFrame:
    """Inclusive prefix sums in the order of a unique column."""
    return running_sum(df, [order], value, name)


def cumulative_array(values: Column) -> Column:
    """Inclusive prefix sums of an array of numbers; null from a null element on.

    An Arrow function: built-in higher-order functions would copy the sums at each step.
    """

    def sums(own) -> pa.Array:
        if own is None:
            return None
        x = np.asarray(own, np.float64)
        gap = np.flatnonzero([v is None for v in own]) if None in own else ()
        upto = np.cumsum(x if not len(gap) else x[: gap[0]]).tolist()
        return upto + [None] * (len(own) - len(upto))

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if column.null_count or column.values.null_count:
                yield pa.array([sums(v) for v in column.to_pylist()], pa.list_(pa.float64()))
                continue
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(column).to_pylist()])
            out = np.empty(len(flat))
            for a, z in zip(ends, ends[1:], strict=False):
                np.cumsum(flat[a:z], out=out[a:z])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "array<double>")(values.cast("array<double>"))

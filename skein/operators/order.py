"""Ranked access, neighbours, stable sorts, ordered merges and differences of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.staged import staged

#: Rows that one task numbers; and ranges up to which a row for each is broadcast.
RANGE_ROWS = 1_000_000
BROADCAST_RANGES = 100_000
#: Bits of an id that tell the place within a range.
INSIDE = 33


def _ranged(df: DataFrame, order: Sequence[str], range_rows: int, sort: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_range`` and, if sorted, ``_in``, their place from 0 in it; and (_range, _n, _before), how many rows a range has and come before it.

    The rows are dealt by Spark's sampled ranges of the order and written once, as another run might sample other bounds.
    """
    parts = 1 + df.count() // range_rows
    dealt = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    if sort:
        dealt = dealt.sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    rows = staged(dealt.withColumn("_id", number), "ranges").withColumn("_range", F.shiftright("_id", INSIDE)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << INSIDE) - 1))).drop("_id")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))
    return rows, F.broadcast(before) if parts <= BROADCAST_RANGES else before


def positions(df: DataFrame, order: Sequence[str], name: str = "place", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with their 1-origin place in a total order (null first).

    Rows are sorted and numbered within ranges of the order, and each range begins after the rows of those before it, so
    no task holds more than about ``range_rows`` rows. The ranges take all columns of the order, so equal values of the
    first ones are split too.
    """
    rows, before = _ranged(df, order, range_rows)
    return rows.join(before, "_range").withColumn(name, F.col("_in") + F.col("_before") + 1).drop("_range", "_in", "_before", "_n")


def running_sum(df: DataFrame, order: Sequence[str], weight: str, name: str = "upto", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with the inclusive sum of weights up to each in a total order, by ranges as ``positions`` numbers them."""
    rows, _ = _ranged(df, order, range_rows)
    sums = rows.groupBy("_range").agg(F.sum(weight).alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).drop("_s")
    inside = Window.partitionBy("_range").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum(weight).over(inside))
    return summed.join(before, "_range").withColumn(name, F.col("_sum") + F.col("_before")).drop("_range", "_in", "_before", "_sum")


def nth(df: DataFrame, order: Sequence[str], n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The order statistic at 0-origin place ``n``; a negative one counts from the end. Only the range that holds it is sorted."""
    rows, before = _ranged(df, order, range_rows, sort=False)
    at = F.lit(n) if n >= 0 else F.sum("_n").over(Window.partitionBy()) + n
    held = before.withColumn("_at", at).filter("_before <= _at AND _at < _before + _n").select("_range", (F.col("_at") - F.col("_before")).alias("_at"))
    placed = rows.join(F.broadcast(held), "_range").withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return placed.filter("_place = _at + 1").drop("_range", "_in", "_at", "_place")


def weighted_nth(df: DataFrame, key: str, weight: str, ns: Sequence[int]) -> DataFrame:
    """For each 0-origin place, the key that holds it when a key counts ``weight`` times."""
    sums = df.groupBy(key).agg(F.sum(weight).alias("_w")).filter("_w > 0")
    running = running_sum(sums, [key], "_w", "_upto")
    wanted = F.explode(F.array(*(F.lit(n).cast("long") for n in ns))).alias("n")
    held = running.select("*", wanted).filter((F.col("_upto") > F.col("n")) & (F.col("_upto") - F.col("_w") <= F.col("n")))
    return held.select("n", key)


def weighted_quantiles(df: DataFrame, x: str, weight: str, qs: Sequence[float], group: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """(group..., q, value): each group's exact quantiles, interpolated, of distinct values that count ``weight`` times.

    The values are dealt to ranges as ``positions`` deals them, and only the ranges that hold a quantile are shuffled and summed
    up to its place, so what a task reads there follows from the quantiles and ``range_rows``, not from the number of values.
    Where more than BROADCAST_RANGES places are asked for, the values may be shuffled to find them.
    """
    rows, _ = _ranged(df, [*group, x], range_rows, sort=False)
    by = Window.partitionBy(*group)
    sums = rows.groupBy(*group, "_range").agg(F.sum(weight).alias("_s"))
    sums = sums.select("*", (F.sum("_s").over(by.orderBy("_range")) - F.col("_s")).alias("_before"), F.sum("_s").over(by).alias("_total"))
    asked = sums.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))).withColumn("_at", (F.col("_total") - 1) * F.col("q"))
    asked = asked.filter((F.col("_before") <= F.ceil("_at")) & (F.floor("_at") < F.col("_before") + F.col("_s")))
    keys = [*group, "_range"]
    held = staged(asked.select(*(F.col(k).alias(f"_h{k}") for k in keys), "_before", "q", "_at"), "held")
    small = F.broadcast if held.count() <= BROADCAST_RANGES else lambda df: df
    same = [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys]
    near = rows.join(small(held.select(*(f"_h{k}" for k in keys)).distinct()), same, "left_semi")
    upto = near.withColumn("_upto", F.sum(weight).over(Window.partitionBy(*keys).orderBy(x)))
    placed = upto.join(small(held), same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    at = lambda place: F.max(F.when((place < F.col("_upto")) & (F.col("_upto") - F.col(weight) <= place), F.col(x)))
    ends = placed.groupBy(*group, "q", "_at").agg(at(F.floor("_at")).alias("_lo"), at(F.ceil("_at")).alias("_hi"))
    over = F.col("_at") - F.floor("_at")
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * (1 - over) + F.col("_hi") * over)
    return ends.select(*group, "q", value.alias("value"))


def ranks(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    return positions(df, order, name)


def seek(df: DataFrame, key: str, wanted) -> DataFrame:
    """Whether a key is there, and the least key that isn't smaller."""
    return df.agg(F.coalesce(F.bool_or(F.col(key) == wanted), F.lit(False)).alias("found"), F.min(F.when(F.col(key) >= wanted, F.col(key))).alias("lower_bound"))


def extremes(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("least"), F.max(key).alias("greatest"))


def neighbours(df: DataFrame, order: Sequence[str], key: str, group: Sequence[str] = ()) -> DataFrame:
    """Each row's predecessor and successor in the order, within its group."""
    if group:
        by = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn("before", F.lag(key).over(by)).withColumn("after", F.lead(key).over(by))
    # no group: the windows lie within ranges, whose first and last rows look at the ranges next to them
    rows, sizes = _ranged(df, order, RANGE_ROWS)
    ends = rows.groupBy("_range").agg(F.min_by(key, "_in").alias("_first"), F.max_by(key, "_in").alias("_last"))
    ends = ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_prior"), F.lead("_first").over(Window.orderBy("_range")).alias("_next"))
    by = Window.partitionBy("_range").orderBy("_in")
    out = rows.withColumn("before", F.lag(key).over(by)).withColumn("after", F.lead(key).over(by)).join(sizes, "_range").join(ends, "_range")
    out = out.withColumn("before", F.when(F.col("_in") == 0, F.col("_prior")).otherwise(F.col("before"))).withColumn("after", F.when(F.col("_in") == F.col("_n") - 1, F.col("_next")).otherwise(F.col("after")))
    return out.drop("_range", "_in", "_n", "_before", "_prior", "_next")


def run_ends(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first and last row, by insertion order, of each run of equal keys, and its length."""
    return df.groupBy(key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def stable_sort(df: DataFrame, keys: Sequence[str], order: str, descending: Sequence[str] = ()) -> DataFrame:
    """Sorted by the keys, the most significant first; equal rows in insertion order, or the last first if ``descending`` names it."""
    return df.orderBy(*(F.col(k).desc() if k in descending else F.col(k).asc() for k in [*keys, order]))


def merge(inputs: Sequence[DataFrame], key: str) -> DataFrame:
    """The ordered merge of inputs: duplicates kept, equal keys by the input's number; ``place`` is 1-origin."""
    whole = None
    for k, df in enumerate(inputs):
        one = df.select(F.col(key), F.lit(k).alias("source"))
        whole = one if whole is None else whole.unionByName(one)
    return positions(whole, [key, "source"], "place")


def succeeding(df: DataFrame, value: str, order: Sequence[str], series: Sequence[str], stride: int = 1, overlapping: bool = False) -> DataFrame:
    """Pairs (x0, x) of a series ``stride`` apart: every ``stride``-th pair, or all with ``overlapping``."""
    by = Window.partitionBy(*series).orderBy(*order)
    pairs = df.withColumn("_n", F.row_number().over(by) - 1).withColumn("x0", F.lag(value, stride).over(by)).withColumn("x", F.col(value))
    pairs = pairs.filter(F.col("_n") >= stride)
    return (pairs if overlapping else pairs.filter(F.col("_n") % stride == 0)).drop("_n")


def diffs(pairs: DataFrame) -> DataFrame:
    """First differences, ratios and returns of the pairs; a ratio to zero is null."""
    ratio = F.try_divide(F.col("x").cast("double"), F.col("x0").cast("double"))
    return pairs.withColumn("diff", F.col("x") - F.col("x0")).withColumn("ratio", ratio).withColumn("ret", ratio - 1)


def second_diffs(df: DataFrame, value: str, order: Sequence[str], series: Sequence[str]) -> DataFrame:
    by = Window.partitionBy(*series).orderBy(*order)
    first = df.withColumn("_d", F.col(value) - F.lag(value).over(by))
    return first.withColumn("diff2", F.col("_d") - F.lag("_d").over(by)).filter("diff2 IS NOT NULL").drop("_d")

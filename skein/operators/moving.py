"""Moving and time-weighted histograms. Time is the row's place in its series."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skein.functions.bins import Bins
from skein.operators.hist import quantiles
from skein.operators.stats import frame

FLAT, LINEAR, EXPONENTIAL = "flat", "linear", "exponential"


def weighted_frames(df: DataFrame, bin_: Column, row: Sequence[str], series: Sequence[str], order: Sequence[str], win: int, kernel: str = FLAT, old: float = 0.9375) -> DataFrame:
    """(row..., bin, cnt): for each row the weighted histogram of the last ``win`` rows of its series.

    A point's weight is 1, its 1-origin place in the frame, or ``old`` to the power of its age. Rows multiply by ``win``
    before they are summed, so this suits windows of up to about a thousand rows; see ``running_quantiles`` beyond.
    """
    framed = df.withColumn("_b", bin_).withColumn("_frame", F.collect_list(F.struct(F.col("_b").alias("b"))).over(frame(series, order, win)))
    points = framed.select(*row, F.size("_frame").alias("_n"), F.posexplode("_frame").alias("_at", "_p"))
    weight = {
        FLAT: F.lit(1.0),
        LINEAR: (F.col("_at") + 1).cast("double"),
        EXPONENTIAL: F.pow(F.lit(float(old)), (F.col("_n") - 1 - F.col("_at")).cast("double")),
    }[kernel]
    return points.filter("_p.b IS NOT NULL").groupBy(*row, F.col("_p.b").alias("bin")).agg(F.sum(weight).alias("cnt"))


def moving_quantiles(df: DataFrame, x: str, bins: Bins, qs: Sequence[float], row: Sequence[str], series: Sequence[str], order: Sequence[str], win: int, kernel: str = FLAT, old: float = 0.9375) -> DataFrame:
    """Mid-rank quantiles of the last ``win`` rows under a time kernel, for each row."""
    return quantiles(weighted_frames(df, bins.index(F.col(x)), row, series, order, win, kernel, old), qs, row, bins.value)


def decayed_histogram(df: DataFrame, bin_: Column, series: Sequence[str], order: Sequence[str], old: float) -> DataFrame:
    """(series..., bin, cnt) after the last row: a point of age k weighs ``old`` to the power k. Relative weights, so that none overflows."""
    by = Window.partitionBy(*series).orderBy(*(F.col(c).desc() for c in order))
    aged = df.withColumn("bin", bin_).withColumn("_age", F.row_number().over(by) - 1)
    return aged.filter("bin IS NOT NULL").groupBy(*series, "bin").agg(F.sum(F.pow(F.lit(float(old)), F.col("_age").cast("double"))).alias("cnt"))


def moving_median(df: DataFrame, x: str, series: Sequence[str], order: Sequence[str], win: int, name: str = "median") -> DataFrame:
    """The element at half the length of the sorted window, not interpolated."""
    over = frame(series, order, win)
    at = F.floor(F.count(F.lit(1)).over(over) / 2).cast("int") + 1
    return df.withColumn(name, F.element_at(F.array_sort(F.collect_list(x).over(over)), at))


def interpolated(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """The mid-rank quantile of sorted values with weights."""
    keep = weights > 0
    if not keep.any():
        return float("nan")
    weights = weights[keep]
    return float(np.interp(q * weights.sum(), weights.cumsum() - weights / 2, values[keep]))


def running_quantiles(df: DataFrame, x: str, values: Sequence[float], index: Column, q: float, row: Sequence[str], series: Sequence[str], order: Sequence[str], old: float, win: int | None = None) -> DataFrame:
    """A quantile for each row under exponential weights, over all earlier rows or the last ``win``.

    One incremental pass over each series: a bin's weight ages by ``old`` with each row. ``values`` are the bins' values
    in order, and ``index`` a row's 0-origin bin. A series is one task's work, as each row's state follows from the last.
    """
    points, names = np.array(values, float), [*row, *(c for c in series if c not in row)]
    schema = StructType([df.schema[c] for c in names] + [StructField("value", DoubleType())])

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(list(order), kind="stable")
        weights, last, out = np.zeros(len(points)), deque(), []
        # how many points of the window each bin holds: without one it weighs nothing, whatever rounding left
        held = np.zeros(len(points), np.int64)
        for b in own["_bin"]:
            weights *= old
            if win and len(last) == win:
                gone = last.popleft()
                if gone is not None:
                    held[gone] -= 1
                    weights[gone] = max(0.0, weights[gone] - old**win) if held[gone] else 0.0
            known = None if pd.isna(b) else int(b)
            if win:
                last.append(known)
            if known is not None:
                weights[known] += 1
                held[known] += 1
            out.append(interpolated(points, np.where(weights < 1e-300, 0, weights), q))
        return own[names].assign(value=out)

    kept = df.withColumn("_bin", index).select(*dict.fromkeys([*names, *order, "_bin"]))
    return kept.groupBy(*series).applyInPandas(run, schema)

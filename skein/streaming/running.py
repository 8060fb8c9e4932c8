"""Streaming forms: running counters, and moving statistics over the last rows of each series.

Order within a series is event time, then arrival. Rows later than the watermark are dropped; the others of a batch are
put in order before the state sees them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, key: str, amount: str | None = None, name: str = "cnt") -> DataFrame:
    """Counters by key; for output mode update or complete."""
    return stream.groupBy(key).agg((F.count(F.lit(1)) if amount is None else F.sum(amount)).alias(name))


def windowed_counts(stream: DataFrame, key: str, time: str, width: str, late: str) -> DataFrame:
    """Counters by key and time window, with a watermark; for output mode append or update."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("cnt"))


def moving_stats(stream: DataFrame, series: str, time: str, value: str, win: int, late: str = "1 hour") -> DataFrame:
    """For each row: the count, mean and median (at half the length) of the last ``win`` values of its series.

    The state of a series is its last ``win`` values.
    """
    kind = stream.schema[series].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for moment, x in zip(rows[time], rows[value], strict=True):
            last = [*last, float(x)][-win:]
            ordered = np.sort(last)
            out.append((key[0], moment, len(last), float(np.mean(last)), float(ordered[len(last) // 2])))
        state.update((last,))
        yield pd.DataFrame(out, columns=[series, time, "n", "mean", "median"])

    kept = stream.withWatermark(time, late).select(series, time, value).filter(F.col(value).isNotNull())
    return kept.groupBy(series).applyInPandasWithState(step, f"{series} {kind}, {time} timestamp, n long, mean double, median double", "last array<double>", "append", "NoTimeout")


def decayed_counts(stream: DataFrame, key: str, time: str, old: float, late: str = "1 hour") -> DataFrame:
    """Frecency of each key by its own arrivals: all earlier weight falls by ``old`` with each record of the key."""
    kind = stream.schema[key].dataType.simpleString()

    def step(own: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        weight, n = state.get if state.exists else (0.0, 0)
        for batch in batches:
            m = len(batch)
            weight = weight * old**m + (1 - old**m) / (1 - old)
            n += m
        state.update((weight, n))
        yield pd.DataFrame([(own[0], weight, n)], columns=[key, "weight", "n"])

    kept = stream.withWatermark(time, late).select(key, time)
    return kept.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, weight double, n long", "weight double, n long", "update", "NoTimeout")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what there is into Parquet files in a shared folder, and read them. A batch that runs again replaces its files."""
    out = f"{folder}/out"
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch-none")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch-{'last' if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)

"""t-digests: weighted centroids, finest at the tails, as an array column that merges.

Each task builds digests of its own rows where they lie, so that only centroids are shuffled and a group with most of the rows
is no single task's work; the tasks' digests are merged in parts and then whole. Centroids hold what lies within one step of the scale function; the least and greatest value stay alone,
so quantiles 0 and 1 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTROIDS = "array<struct<m:double,w:double>>"
#: Parts that a group's digests are merged in first.
PARTS = 64
#: Values that a task holds before it compresses them.
HELD = 200_000


def compress(m: np.ndarray, w: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of weighted values, about ``size`` of them: neighbours within one step of a logarithmic scale are joined."""
    order = np.argsort(m, kind="stable")
    m, w = m[order], w[order]
    if len(m) < 3:
        return m, w
    total = w.sum()
    q = (np.cumsum(w) - w / 2) / total
    step = size / (4 * np.log(max(total / size, 1.0)) + 24)
    cell = np.floor(step * np.log(q / (1 - q)))
    new = np.r_[True, cell[1:] != cell[:-1]]
    new[[1, -1]] = True
    at = np.flatnonzero(new)
    weights = np.add.reduceat(w, at)
    return np.add.reduceat(m * w, at) / weights, weights


def _rows(m: np.ndarray, w: np.ndarray) -> list[dict]:
    return [{"m": a, "w": b} for a, b in zip(m.tolist(), w.tolist(), strict=True)]


def digest(df: DataFrame, x: str, group: Sequence[str] = (), weight: Column | None = None, size: float = 100) -> DataFrame:
    """(group..., centroids). NaN is an error, null is skipped, weights must be positive."""
    value = F.col(x).cast("double")
    checked = F.when(F.isnan(value), F.raise_error(F.lit("a digest can't hold NaN")).cast("double")).otherwise(value)
    rows = df.filter(F.col(x).isNotNull()).select(*group, checked.alias("_m"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"))
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    schema = f"{kinds + ', ' if kinds else ''}centroids {CENTROIDS}"
    n = len(group)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[pa.Array], list[np.ndarray], list[np.ndarray]]] = {}
        waiting = 0
        for batch in batches:
            values, weights = (c.to_numpy(zero_copy_only=False) for c in batch.columns[n:])
            for at in _by_group(batch, n):
                own = [c.take(pa.array(at[:1])) for c in batch.columns[:n]]
                _, ms, ws = held.setdefault(repr([c[0].as_py() for c in own]), (own, [], []))
                ms.append(values[at])
                ws.append(weights[at])
            waiting += batch.num_rows
            if waiting > HELD:
                waiting = 0
                for _, ms, ws in held.values():
                    ms[:], ws[:] = zip(compress(np.concatenate(ms), np.concatenate(ws), size))
                    waiting += len(ms[0])
                if waiting > HELD // 2:  # many groups: what is built goes on to the merge
                    yield _batch(held, group, size)
                    held, waiting = {}, 0
        if held:
            yield _batch(held, group, size)

    return merge(rows.mapInArrow(build, schema), group, size)


def _by_group(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """The places of the rows of each group, the batch's first ``n`` columns."""
    if not batch.num_rows:
        return []
    code = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[:n]:
        try:
            own = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        except pa.ArrowNotImplementedError:  # nested values
            own = pd.factorize(np.array([repr(v) for v in column.to_pylist()], object))[0].astype(np.int64)
        code = np.unique(code * (own.max() + 1) + own, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def _batch(held: dict, group: Sequence[str], size: float) -> pa.RecordBatch:
    made = [compress(np.concatenate(ms), np.concatenate(ws), size) for _, ms, ws in held.values()]
    m, w = (pa.array(np.concatenate([d[k] for d in made])) for k in (0, 1))
    ends = pa.array(np.cumsum([0, *(len(d[0]) for d in made)]), pa.int32())
    centroids = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([m, w], names=["m", "w"]))
    keys = [pa.concat_arrays([own[k] for own, _, _ in held.values()]) for k in range(len(group))]
    return pa.RecordBatch.from_arrays([*keys, centroids], names=[*group, "centroids"])


def merge(digests: DataFrame, group: Sequence[str] = (), size: float = 100) -> DataFrame:
    """The digest of each group's digests. Those of a group are merged in PARTS parts by their partition, then the parts."""
    kinds = ", ".join(f"`{g}` {digests.schema[g].dataType.simpleString()}" for g in group)
    schema = f"{kinds + ', ' if kinds else ''}centroids {CENTROIDS}"
    parts = digests.select(*group, "centroids", (F.spark_partition_id() % PARTS).alias("_part"))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        made = _rows(*compress(own["_m"].to_numpy(float), own["_w"].to_numpy(float), size))
        return pd.DataFrame({**{g: [own[g].iloc[0]] for g in group}, "centroids": [made]})

    def joined(df: DataFrame, by: Sequence[str]) -> DataFrame:
        flat = df.select(*by, F.explode("centroids").alias("_c")).select(*by, F.col("_c.m").alias("_m"), F.col("_c.w").alias("_w"))
        return flat.groupBy(*by).applyInPandas(build, schema)

    whole = joined(parts, [*group, "_part"])
    return joined(whole, group) if group else joined(whole.withColumn("_all", F.lit(0)), ["_all"])


def quantiles(digests: DataFrame, qs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group..., q, value): interpolated over the middles of the centroids' ranks. A q outside of 0..1 is an error."""
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles are asked for in 0..1")
    return _at(digests, qs, group, "q", "value", lambda m, w, q: np.interp(np.array(q) * w.sum(), np.cumsum(w) - w / 2, m))


def cdf(digests: DataFrame, xs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group..., x, share): the share of weight up to each value; 0 below the least, 1 from the greatest on."""

    def share(m: np.ndarray, w: np.ndarray, at: Sequence[float]) -> np.ndarray:
        at = np.array(at)
        inner = np.interp(at, m, (np.cumsum(w) - w / 2) / w.sum())
        return np.where(at < m[0], 0.0, np.where(at >= m[-1], 1.0, inner))

    return _at(digests, xs, group, "x", "share", share)


def weight(digests: DataFrame) -> DataFrame:
    return digests.withColumn("weight", F.aggregate("centroids", F.lit(0.0), lambda a, c: a + c["w"]))


def _at(digests: DataFrame, points: Sequence[float], group: Sequence[str], name: str, out: str, find) -> DataFrame:
    kinds = ", ".join(f"`{g}` {digests.schema[g].dataType.simpleString()}" for g in group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for _, row in batch.iterrows():
                m, w = (np.array([c[k] for c in row["centroids"]], float) for k in ("m", "w"))
                found = find(m, w, points) if len(m) else np.full(len(points), np.nan)
                parts.append(pd.DataFrame({**{g: row[g] for g in group}, name: list(map(float, points)), out: found}))
            if parts:
                yield pd.concat(parts)

    return digests.mapInPandas(run, f"{kinds + ', ' if kinds else ''}{name} double, {out} double")

"""Staging tables in the cluster's shared folder, and small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of bare keys (at most a few dozen bytes each) up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 250_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 22
#: Bytes of text that a Python worker takes out of an Arrow batch at a time.
SLICE_BYTES = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one is set only where the session names none and runs locally."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_dir(spark)}/skein-{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def clear_staged(spark: SparkSession) -> None:
    """Delete what this process staged. To be called once results that read it are written."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small_or_shuffled(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a staged table of keys if it has at most ``rows`` rows; else forbid one."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side.hint("shuffle_merge")


def without_ids(docs: DataFrame, drop: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``drop`` (one staged column, no nulls). Rows with a null id stay."""
    key = free_name(docs, "drop_id")
    drop = drop.toDF(key)
    return docs.join(small_or_shuffled(drop), docs[doc_id] == drop[key], "left_anti")


def bounded_batches(df: DataFrame) -> None:
    """Have Spark send Python at most BATCH_BYTES at a time in this session, where its setting is larger: batches are off
    the heap in the JVM, several for each task, and by default hold up to 64 MB."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_SETTING, f"{1 << 30}b").rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def slices(column: pa.Array) -> Iterator[list]:
    """The values of a column of texts, as Python objects, in lists of about SLICE_BYTES (one value at least)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(column):
        begin = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, "right")))
        yield column.slice(at, end - at).to_pylist()
        at = end
    pa.default_memory_pool().release_unused()

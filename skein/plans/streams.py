"""Batch tables read as streams, for queries whose operators are streaming ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.sources.staged import shared_path
from skein.streaming import running


def _shared(spark: SparkSession) -> str:
    """A new folder for a stream, in the shared folder that the session names."""
    return shared_path(spark, "stream")


def as_stream(df: DataFrame) -> DataFrame:
    """The rows of a table, as files that a stream reads once."""
    path = f"{_shared(df.sparkSession)}/input"
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def counts_of(df: DataFrame, key: str) -> DataFrame:
    spark = df.sparkSession
    stream = running.running_counts(as_stream(df.select(key)), key)
    return running.run_available(stream, _shared(spark), "complete")


def moving_of(df: DataFrame, series: str, time: str, value: str, win: int) -> DataFrame:
    spark = df.sparkSession
    stream = running.moving_stats(as_stream(df.select(series, time, value)), series, time, value, win)
    return running.run_available(stream, _shared(spark))

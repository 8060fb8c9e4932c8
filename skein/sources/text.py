"""Record and word scans over stored or filed text, bulk constructors, and table and text sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words in the delimiter-set scan. Fixed values.
DELIMITERS = " \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_records(spark: SparkSession, path: str, terminator: str = "\n") -> DataFrame:
    """The records of text files, split at a terminator; column ``line``."""
    return spark.read.option("lineSep", terminator).text(path).withColumnRenamed("value", "line")


def lines(df: DataFrame, text: str = "text", terminator: str = "\n", name: str = "line") -> DataFrame:
    """A row for each record of a stored text. A terminator at the end doesn't begin another record."""
    literal = "\\Q" + terminator + "\\E"
    body = F.when(F.col(text).endswith(terminator), F.expr(f"substring(`{text}`, 1, length(`{text}`) - {len(terminator)})")).otherwise(F.col(text))
    return df.select(F.explode(F.split(body, literal)).alias(name))


def words_alphabetic(df: DataFrame, text: str = "text", name: str = "word") -> DataFrame:
    """Runs of ASCII letters, lowered. Only ASCII letters are, since lowering can turn others into ASCII ones."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.select(F.explode(F.split(lowered, "[^a-z]+")).alias(name)).filter(F.col(name) != "")


def words_between(df: DataFrame, text: str = "text", delimiters: str = DELIMITERS, name: str = "word") -> DataFrame:
    """What lies between characters of a set, case kept, empty words dropped."""
    some = "[" + "".join(f"\\x{ord(c):02x}" for c in delimiters) + "]+"
    return df.select(F.explode(F.split(F.col(text), some)).alias(name)).filter(F.col(name) != "")


def words_visible(df: DataFrame, text: str = "text", name: str = "word") -> DataFrame:
    """Runs of characters above the space, ASCII letters lowered."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.select(F.explode(F.split(lowered, "[\\x00-\\x20]+")).alias(name)).filter(F.col(name) != "")


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian signed 64-bit records of binary files; column ``h``. A file's length is a multiple of eight bytes."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    record = raw.select(F.explode(F.sequence(F.lit(0), (F.length("content") / 8).cast("int") - 1)).alias("k"), "content").filter("k >= 0")
    octets = [F.conv(F.hex(F.expr(f"substring(content, 8 * k + {b + 1}, 1)")), 16, 10).cast("long") for b in range(8)]
    value = octets[0]
    for b in range(1, 8):
        value = value.bitwiseOR(F.shiftleft(octets[b], 8 * b))
    return record.select(value.alias("h"))


def from_keys(spark: SparkSession, keys: Iterable, kind: str, duplicates: bool = False) -> DataFrame:
    """A set of ``keys`` or, with duplicates, a multiset."""
    df = spark.createDataFrame([(k,) for k in keys], f"key {kind}")
    return df if duplicates else df.distinct()


def from_pairs(spark: SparkSession, pairs: Iterable[tuple], key_kind: str, value_kind: str, duplicates: bool = False) -> DataFrame:
    """A table of (key, value, ord); without duplicates the last value of a key stays."""
    df = spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(pairs)], f"key {key_kind}, value {value_kind}, ord long")
    return df if duplicates else df.groupBy("key").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def open_saved(spark: SparkSession, path: str) -> DataFrame:
    """A saved table; its scan prunes columns and row groups, so nothing is loaded before it is used."""
    return spark.read.parquet(path)


def six_digits(x: Column) -> Column:
    """A number to six significant digits, without zeros at the end."""
    digits = F.format_string("%.6g", x.cast("double"))
    return F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0+(e|$)", "$1")).otherwise(digits)


def formatted(df: DataFrame, template: str = "@f @k", key: str = "key", count: str = "count") -> DataFrame:
    """Text of each row: @k the key, @c the count to six significant digits, @f its share of all to nine places."""
    total = df.agg(F.sum(count).alias("total")).first()[0] or 0
    values = {
        "@k": F.col(key).cast("string"),
        "@c": six_digits(F.col(count)),
        "@f": F.format_string("%.9f", F.try_divide(F.col(count).cast("double"), F.lit(float(total)))),
    }
    parts: list[Column] = []
    rest = template
    while rest:
        if rest[:2] in values:
            parts.append(values[rest[:2]])
            rest = rest[2:]
        else:
            parts.append(F.lit(rest[0]))
            rest = rest[1:]
    return df.select(F.concat(*parts).alias("line"))


def write_formatted(df: DataFrame, path: str, template: str = "@f @k", terminator: str = "\n", **columns: str) -> None:
    formatted(df, template, **columns).write.option("lineSep", terminator).text(path)


def rendered(df: DataFrame, key: str, value: str | None = None) -> str:
    """A small set as {a, b} or table as {a: b, ...}, in key order; for display."""
    rows = df.select(F.col(key).cast("string"), *([F.col(value).cast("string")] if value else [])).orderBy(key).collect()
    return "{" + ", ".join(": ".join("null" if x is None else x for x in r) for r in rows) + "}"

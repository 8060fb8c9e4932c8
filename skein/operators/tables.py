"""Keyed tables and multimaps: a DataFrame keyed by a column, with an ``ord`` column where arrival order matters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.sketch import shared_hash

Made = Callable[[Column], Column]


def card(df: DataFrame) -> DataFrame:
    """The number of elements, duplicates included."""
    return df.agg(F.count(F.lit(1)).alias("card"))


def clear(df: DataFrame) -> DataFrame:
    """The table without rows."""
    return df.limit(0)


def add(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The multimap with more rows; keys and pairs that are there already stay and repeat."""
    return df.unionByName(rows)


def contains(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with whether the table has each."""
    mark = df.select(key).distinct().withColumn("had", F.lit(True))
    return keys.join(mark, key, "left").withColumn("had", F.coalesce("had", F.lit(False)))


def include(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The set with the keys that it lacked."""
    return df.select(key).union(keys.select(key)).distinct()


def upsert(df: DataFrame, updates: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last write wins: updates are later than the table's rows, and later updates than earlier ones."""
    both = df.select(key, value, F.lit(0).alias("late"), F.col(order)).unionByName(updates.select(key, value, F.lit(1).alias("late"), F.col(order)))
    return both.groupBy(key).agg(F.max_by(value, F.struct("late", order)).alias(value))


def last_write(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def get(df: DataFrame, keys: DataFrame, key: str, value: str, default: Column | None = None, required: bool = False) -> DataFrame:
    """The value of each of ``keys``: null, a default, or an error where the table lacks the key."""
    found = keys.join(df.select(key, value, F.lit(True).alias("_had")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no such key: "), F.col(key).cast("string"))).cast(df.schema[value].dataType) if required else (F.lit(None) if default is None else default)
    return found.withColumn(value, F.when(F.col("_had"), F.col(value)).otherwise(missing)).drop("_had")


def get_or_put(df: DataFrame, keys: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """The table with a default for the keys that it lacked; ``had`` tells which it had."""
    both = df.select(key, value, F.lit(True).alias("had")).unionByName(
        keys.select(key).distinct().join(df.select(key), key, "left_anti").select(key, default.alias(value), F.lit(False).alias("had"))
    )
    return both


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def delete_one(df: DataFrame, keys: DataFrame) -> DataFrame:
    """A multiset without one occurrence for each occurrence in ``keys``."""
    return df.exceptAll(keys)


def take(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows taken out, the rows that remain)."""
    named = keys.select(key).distinct()
    return df.join(named, key, "left_semi"), df.join(named, key, "left_anti")


def pop_last(df: DataFrame, order: str) -> DataFrame:
    """The last row by insertion order; no row of an empty table."""
    return df.orderBy(F.col(order).desc()).limit(1)


def edit_or_init(df: DataFrame, keys: DataFrame, key: str, value: str, edit: Made, init: Column) -> DataFrame:
    """The table with ``edit`` applied to the values of ``keys`` that it has, and ``init`` for those that it lacks."""
    named = keys.select(key).distinct().withColumn("_named", F.lit(True))
    found = df.select(key, value, F.lit(True).alias("_had")).join(named, key, "full")
    new = F.when(F.col("_had").isNull(), init).when(F.col("_named"), edit(F.col(value))).otherwise(F.col(value))
    return found.select(key, new.alias(value))


def edit_key(df: DataFrame, key: str, old, new) -> DataFrame:
    """A key renamed; its row keeps its place in the insertion order."""
    return df.withColumn(key, F.when(F.col(key) == F.lit(old), F.lit(new)).otherwise(F.col(key)))


def nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """The row at a place of the insertion order, from 0; counted from the end if ``n`` is negative."""
    way = F.col(order).asc() if n >= 0 else F.col(order).desc()
    back = F.col(order).desc() if n >= 0 else F.col(order).asc()
    place = n if n >= 0 else -n - 1
    first = df.orderBy(way).limit(place + 1)
    return first.orderBy(back).limit(1) if place == 0 else first.join(first.agg(F.count(F.lit(1)).alias("_n")), F.col("_n") == place + 1).drop("_n").orderBy(back).limit(1)


def map_set(df: DataFrame, key: str, op: Made, name: str = "image") -> DataFrame:
    return df.select(op(F.col(key)).alias(name)).distinct()


def index_by(df: DataFrame, op: Made, order: str, name: str = "index_key") -> DataFrame:
    """Rows keyed by a function of them; the last of each key stays."""
    whole = F.struct(*df.columns)
    return df.groupBy(op(F).alias(name)).agg(F.max_by(whole, order).alias("row")).select(name, "row.*")


def set_hash(df: DataFrame, key: str) -> DataFrame:
    """A hash of the set that doesn't depend on order."""
    return df.select(key).distinct().agg(F.bit_xor(shared_hash(F.col(key))).alias("set_hash"))


def skew(df: DataFrame, key: str, parts: int, hashed: Column | None = None) -> DataFrame:
    """Rows of each hash partition, by Spark's hash or a given one: the counterpart of a report on probe depths."""
    return df.groupBy(F.pmod(F.hash(key) if hashed is None else hashed, F.lit(parts)).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def all_values(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The list of each key's values, in insertion order."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.transform(listed, lambda x: x[value]).alias("values"))


def values_of(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every row whose key is among ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("num_items"))


def signature(word: Column) -> Column:
    """The sorted letters of a word: equal for anagrams."""
    return F.array_join(F.array_sort(F.split(F.lower(word), "")), "")


def anagrams(words: DataFrame, word: str = "word", least: int = 2) -> DataFrame:
    """Groups of distinct words with the same letters."""
    groups = words.select(F.col(word)).distinct().groupBy(signature(F.col(word)).alias("letters")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(word)), " ").alias("words"))
    return groups.filter(F.col("n") >= least)


def in_universe(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """The rows, with an error for a key outside of a direct-indexed table's universe ``low..high``."""
    inside = F.col(key).between(low, high)
    return df.withColumn(key, F.when(inside, F.col(key)).otherwise(F.raise_error(F.lit(f"key outside of {low}..{high}")).cast(df.schema[key].dataType)))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")

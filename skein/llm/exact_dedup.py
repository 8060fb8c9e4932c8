"""Exact duplicates by a digest of the text, with frequent digests split off.

A Misra-Gries pass over the digests names at most ``1 / support`` candidates. Their exact counts confirm the winners
(more than ``support`` of all rows each, so no more than ``1 / support`` of them whatever the table's size); the winners
are broadcast and their rows resolved where they lie. The other digests, each in at most ``support`` of the rows, take
one ordinary shuffle of (digest, length, id) rows. Texts are never shuffled.

Defined results: a null text is an empty one. Among equal texts, the one with the most code points stays, then the
smallest doc_id (a null id after all others), then one row of those that are still equal. Repeated rows are copies like
any others. An empty table gives an empty result. Further columns of the input are ignored by ``exact_groups`` and kept
by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import free_name, small_or_shuffled, stage

#: A digest with more than this share of all rows is resolved on the map side.
SUPPORT = 1e-3


def text_digest(text: Column) -> Column:
    """SHA-256, in lowercase hex, of the text without spaces, tabs, line breaks, vertical tabs and form feeds."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)


def _digests(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            text_digest(F.col(text)).alias("text_sha256"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "digests",
    )


def _winners(rows: DataFrame, support: float) -> DataFrame:
    """(text_sha256, group_size, best) of the verified frequent digests: fewer than 1 / support rows."""
    candidates = rows.stat.freqItems(["text_sha256"], support).select(F.explode(F.col("text_sha256_freqItems")).alias("text_sha256"))
    best = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid")))
    counted = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    return stage(counted.filter(F.col("group_size") > support * rows.count()), "frequent")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _digests(docs, text, doc_id)
    winners = _winners(rows, support)
    heavy = rows.join(F.broadcast(winners), "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256"
    )
    order = Window.partitionBy("text_sha256").orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_last(), "rid")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "doc_id",
        F.first("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
        "text_sha256",
    )
    return heavy.unionByName(light)


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Dropped rows are named by their id, which outlives a rescan where row numbers wouldn't. Only rows of ids that have
    both rows that stay and rows that go are hashed again: those with a kept digest stay, one row for each.
    """
    groups = exact_groups(docs, text, doc_id, support)
    digest, key, sha, one = (free_name(docs, x) for x in ("digest", "drop_id", "drop_sha", "row_of_key"))
    kept = groups.groupBy("doc_id").agg(F.bool_and("kept").alias("every"), F.bool_or("kept").alias("some"))
    marks = stage(kept.filter("NOT every").select(F.col("doc_id").alias(key), F.col("some").alias(one)), "drops")
    gone, mixed = marks.filter(~F.col(one)).select(key), marks.filter(F.col(one)).select(key)
    same_id = F.col(doc_id).eqNullSafe(F.col(key))
    left = docs.join(small_or_shuffled(gone), same_id, "left_anti")
    if mixed.isEmpty():
        return left
    mixed = small_or_shuffled(mixed)
    stay = groups.filter("kept").join(mixed, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    stay = stage(stay.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)), "kept-texts")
    hashed = left.join(mixed, same_id, "left_semi").withColumn(digest, text_digest(F.col(text)))
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))
    of_kept = hashed.join(small_or_shuffled(stay), same_id & (F.col(digest) == F.col(sha)), "left_semi")
    taken = of_kept.withColumn(one, F.row_number().over(Window.partitionBy(doc_id, digest).orderBy(size.desc(), F.col(text).desc())))
    return left.join(mixed, same_id, "left_anti").unionByName(taken.filter(F.col(one) == 1).drop(one, digest))

"""SimHash near-dedup by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Candidates come from the pigeonring filtering of ``simhash``, over a longer fingerprint: eight rings of 64 bits, a SimHash
of the set of a text's words. Words and not shingles are its features, as one changed word changes five shingles: texts of
similarity 0.8 by five-word shingles that differ by edits share 97 to 98 % of their words, so that a ring differs in four
bits or so, where a SimHash of the shingles would differ in ten. Texts are candidates if a ring of theirs is in the same
component of fingerprints within three bits.

Candidates are pruned by a Hamming check that loses nothing. A text's parity bits count its shingles' hashes modulo 1,024,
each bit being odd or even; every bit that differs shows a shingle that only one text has, and a similarity of 0.8 allows
a ninth of both sets' sizes of those. What passes is decided by the whole sets, of 64-bit hashes of the shingles.

Only distinct sets take part. Each group of candidates is searched breadth first, from the text nearest to the bits' majority,
and gives links that span it. After they are decided, the pairs that pass the check and are in different trees still are
decided too, so that no candidate that could link two trees is left out and pairs within a tree are never listed. Groups of
over CHUNK texts are divided, with some texts in every part. Texts aren't shuffled, but the sets of candidates are.

Defined results: words are split and lowered as in ``simhash``. A text of fewer than five words is one shingle; a null
text is an empty one, and texts without words are equal to each other, as are texts whose sets have the same 64-bit digest.
Rows without an id link others and stay. An empty table gives an empty result. Further columns are kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import bounded_batches, slices, small_or_shuffled, stage, without_ids
from skein.llm.simhash import HOT, SEED, components, ring_links, whole_runs

WORDS = 5
#: Least Jaccard similarity, as a fraction, so that the decision is exact.
LEAST = (4, 5)
RINGS = 8
#: Bits of the parities.
BITS = 1024
#: Candidates that one task searches together; and of a larger group, about how many are in each of its parts.
CHUNK, SHARED = 4096, 32

#: Odd numbers by which a hash becomes one for each ring.
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 64, RINGS, np.uint64) | np.uint64(1)
SKETCH = "struct<fp:bigint,n:int,rings:array<bigint>,parity:binary>"
SETS = "struct<fp:bigint,n:int,shingles:array<bigint>>"


def _hashes(pieces) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), np.uint64)


def shingle_set(found: list[bytes], words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    if not found:
        return np.empty(0, np.uint64)
    runs = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else iter([found])
    return np.unique(_hashes(map(b" ".join, runs)))


def digest(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def ring_fingerprints(found: list[bytes]) -> np.ndarray:
    """SimHashes of the set of words, one for each ring."""
    hashes, ones = np.unique(_hashes(set(found))), np.zeros(64 * RINGS, np.int64)
    for k in range(0, len(hashes), 255):
        mixed = hashes[k : k + 255, None] * _TIMES
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def parities(own: np.ndarray) -> bytes:
    counts = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)))


def _text_column(text: Column, kind: str, make) -> Column:
    """A struct of each text's words, by ``make``, which gets lists of words."""

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            made = [make((t or b"").lower().split()) for part in slices(column.cast(pa.binary())) for t in part]
            fps, sizes, *rest = zip(*made, strict=True) if made else [[]] * 4
            arrays = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(list(rest[0]))]
            names = ["fp", "n", "rings" if len(rest) > 1 else "shingles"]
            if len(rest) > 1:
                arrays, names = [*arrays, pa.array(rest[1], pa.binary())], [*names, "parity"]
            yield pa.StructArray.from_arrays(arrays, names=names)

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, kind)(text)


def sketch_column(text: Column, words: int = WORDS) -> Column:
    """A struct of the set's digest and size, the rings and the parities."""

    def make(found: list[bytes]) -> tuple:
        own = shingle_set(found, words)
        return digest(own), len(own), ring_fingerprints(found), parities(own)

    return _text_column(text, SKETCH, make)


def sets_column(text: Column, words: int = WORDS) -> Column:
    """A struct of the set's digest and size, and the set."""

    def make(found: list[bytes]) -> tuple:
        own = shingle_set(found, words)
        return digest(own), len(own), own

    return _text_column(text, SETS, make)


def may_link(parity: np.ndarray, n: np.ndarray, other: np.ndarray, m: int) -> np.ndarray:
    """Which sets, by parities and sizes, may have the least similarity to another."""
    apart = np.maximum(np.bitwise_count(parity ^ other).sum(axis=1, dtype=np.int64), np.abs(n - m))
    return apart * (LEAST[1] + LEAST[0]) <= (n + m) * (LEAST[1] - LEAST[0])


def spanning_pairs(n: np.ndarray, parity: np.ndarray) -> list[tuple[int, int]]:
    """Places of pairs that may link and that span what such pairs connect, breadth first from the middle."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(n), 255):
        ones += np.add.reduce(np.unpackbits(parity[k : k + 255].view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    middle = np.packbits(2 * ones > len(n)).view(np.uint64)
    left = np.argsort(np.bitwise_count(parity ^ middle).sum(axis=1, dtype=np.int64), kind="stable")
    pairs = []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        for x in reached:  # grows
            if not len(left):
                break
            near = may_link(parity[left], n[left], parity[x], n[x])
            if near.any():
                new = left[near].tolist()
                pairs += [(x, y) for y in new]
                reached += new
                left = left[~near]
    return pairs


def cross_pairs(n: np.ndarray, parity: np.ndarray, tree: np.ndarray) -> list[tuple[int, int]]:
    """Places of all pairs that may link and are in different trees. The largest tree's texts are compared with others' only."""
    trees, own, sizes = np.unique(tree, return_inverse=True, return_counts=True)
    outside = own != sizes.argmax()
    done, pairs = ~outside, []
    for x in np.flatnonzero(outside).tolist():
        others = np.flatnonzero((own != own[x]) & (~outside | ~done))
        done[x] = True
        pairs += [(x, y) for y in others[may_link(parity[others], n[others], parity[x], n[x])].tolist()]
    return pairs


def _group_pairs(members: DataFrame, within: bool) -> DataFrame:
    """Pairs (a, b) of each part of the groups; ``members``: gid, part, fp, n, parity, tree."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gids, parts, *columns in whole_runs(batches, 2):
            gid, part = gids.to_numpy(), parts.to_numpy()
            fp, n, tree = (columns[i].to_numpy().astype(np.int64) for i in (0, 1, 3))
            parity = np.frombuffer(b"".join(columns[2].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            cuts = np.flatnonzero((np.diff(gid) != 0) | (np.diff(part) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                pairs = cross_pairs(n[a:z], parity[a:z], tree[a:z]) if within else spanning_pairs(n[a:z], parity[a:z])
                for k in range(0, len(pairs), 1 << 16):
                    at = fp[a:z][np.array(pairs[k : k + (1 << 16)])]
                    yield pa.RecordBatch.from_arrays([pa.array(at.max(axis=1)), pa.array(at.min(axis=1))], names=["a", "b"])

    runs = members.select("gid", "part", "fp", "n", "parity", "tree").repartition("gid", "part").sortWithinPartitions("gid", "part", "fp")
    return runs.mapInArrow(search, "a bigint, b bigint").distinct()


def _divided(members: DataFrame, size: Column, everywhere: Column, chunk: int) -> DataFrame:
    """``members`` with the part of their group that they are in, or all parts for those that are ``everywhere``."""
    parts = F.ceil(size / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(SEED)), parts).cast("int")
    return members.withColumn("part", F.explode(F.when(everywhere, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))))


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """Those of the staged pairs (a, b) whose sets are near, as links (u, v)."""
    wanted = stage(reps.select("fp", "least").join(pairs.select("a").union(pairs.select("b")).distinct().toDF("fp"), "fp", "left_semi"), "candidates")
    some = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = some.join(small_or_shuffled(stage(wanted.select(F.col("least").alias("id")).distinct(), "candidate-ids")), "id", "left_semi")
    if not wanted.filter("least IS NULL").isEmpty():
        found = found.unionByName(some.filter("id IS NULL"))
    sets = found.select(sets_column(F.col("text"), words).alias("s")).select("s.*").join(small_or_shuffled(wanted.select("fp")), "fp", "left_semi")
    sets = stage(sets.dropDuplicates(["fp"]), "candidate-sets")
    # neither side is broadcast, as the sets are large
    both = pairs.join(sets.toDF("a", "na", "own").hint("merge"), "a").join(sets.toDF("b", "nb", "other").hint("merge"), "b")
    common = F.size(F.array_intersect("own", "other")).cast("long")
    near = both.filter(common * LEAST[1] >= (F.col("na") + F.col("nb") - common) * LEAST[0])
    return stage(near.select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")


def _trees(docs: DataFrame, reps: DataFrame, text: str, doc_id: str, words: int, hot: int, chunk: int) -> DataFrame:
    """(node, root) of the sets linked to others."""
    ringed = reps.select("fp", F.posexplode("rings").alias("ring", "print"))
    links = ring_links(ringed.select("ring", F.col("print").alias("fp")).distinct(), hot)
    trees = stage(components(links.select(F.xxhash64("ring", "u").alias("u"), F.xxhash64("ring", "v").alias("v"))), "ring-trees")
    placed = ringed.select("fp", F.xxhash64("ring", "print").alias("node")).join(small_or_shuffled(trees), "node", "left")
    placed = stage(placed.select("fp", F.coalesce("root", "node").alias("gid")), "ring-groups")
    sizes = stage(placed.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "group-sizes")
    members = placed.join(small_or_shuffled(sizes), "gid")
    members = stage(members.join(reps.select("fp", "n", "parity"), "fp"), "members")

    # some texts are in all parts of a group, so that the parts' trees can meet
    shared = F.pmod(F.xxhash64("fp"), F.col("size")) < SHARED
    first = stage(_group_pairs(_divided(members.withColumn("tree", F.col("fp")), F.col("size"), shared, chunk), False), "first-pairs")
    links = _verified(docs, reps, first, text, doc_id, words)
    tree = stage(components(links).toDF("fp", "root"), "first-trees")
    members = members.join(small_or_shuffled(tree), "fp", "left").withColumn("tree", F.coalesce("root", "fp")).drop("root")
    by_tree = stage(members.groupBy("gid", "tree").agg(F.count(F.lit(1)).alias("in_tree")), "group-trees")
    open_groups = by_tree.groupBy("gid").agg(F.max_by("tree", F.struct("in_tree", "tree")).alias("largest"), F.count(F.lit(1)).alias("trees")).filter("trees > 1")
    still = members.join(small_or_shuffled(stage(open_groups.select("gid", "largest"), "open-groups")), "gid")
    rest = _group_pairs(_divided(still, F.col("size"), F.col("tree") != F.col("largest"), chunk), True)
    rest = stage(rest.join(first, ["a", "b"], "left_anti"), "rest-pairs")
    return components(links.unionByName(_verified(docs, reps, rest, text, doc_id, words)).distinct())


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, component_id, the smallest id of its group."""
    bounded_batches(docs)
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), sketch_column(F.col(text), words).alias("s")).select("doc_id", "s.*"), "sketches")
    reps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("rings").alias("rings"), F.first("parity").alias("parity")), "distinct-sets")
    tree = reps.select("fp", "least").join(_trees(docs, reps, text, doc_id, words, hot, chunk).toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = tree.join(tree.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """``docs`` with the document of smallest id of each group, all columns kept. Rows without an id stay."""
    groups = similar_groups(docs, text, doc_id, words)
    drop = stage(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-copies")
    return without_ids(docs, drop, doc_id)

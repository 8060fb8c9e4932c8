"""Near duplicates by SimHash: 64-bit fingerprints that differ in at most three bits are linked.

Candidates come from pigeonring filtering. Split a fingerprint into a ring of eight bytes and let two fingerprints
differ in at most three bits. Then some byte starts a chain of consecutive bytes whose running number of differences
never exceeds 3/8 of a bit per byte: none in two bytes, one in five, two in seven, three in eight. So the two bytes at
the start are equal, and of the 24 bits after them one half is. Each fingerprint therefore goes under 16 keys of 28
bits, eight starts by two halves, and every link lies under a common key. Under a key the remaining budgets prune, and
then the whole Hamming distance decides.

Only distinct fingerprints take part, so exact copies cost nothing here. Under each key a task returns a spanning forest
and never all pairs. A key that more than ``hot`` distinct fingerprints share is split further, exactly: of its
remaining 36 bits at most three differ, so one quarter of them is equal, and it becomes four longer keys; those that are
still hot are split again, until at most 12 bits are open. Within a task large runs are divided the same way on the bits that vary. Links between fingerprints are merged by
alternating star contraction, which stays distributed.

Defined results: a null text is an empty one; a text without words has fingerprint zero and is linked as any other.
component_id is the smallest non-null doc_id reachable, null if there is none. Repeated rows give repeated rows. An
empty table gives an empty result. Further columns of the input are ignored by ``near_groups``; ``one_of_each`` keeps
them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from skein.llm.shared import bounded_batches, slices, small_or_shuffled, stage, without_ids

SEED = 42
MAX_BITS = 3
#: Bytes in the ring, and the differences that a chain of one, two, ... of them may hold.
RING = 8
BUDGET = [MAX_BITS * n // RING for n in range(1, RING + 1)]
#: Keys with more distinct fingerprints than this are split; they are found by one fingerprint in SOME.
HOT = 20_000
SOME = 16
#: Runs up to this many fingerprints are compared directly.
DIRECT = 256
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of word shingles (ASCII lower case, split at ASCII white space), as an unsigned number."""
    found = text.lower().split()
    if not found:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(found) < words:
        shingles = iter([join(found)])
    else:
        shingles = map(join, zip(*(found[i:] for i in range(words)), strict=False))
    ones, n = np.zeros(64, np.int64), 0
    while True:
        hashes = np.fromiter((digest(s, SEED) for _, s in zip(range(CHUNK), shingles, strict=False)), np.uint64)
        if not len(hashes):
            break
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            values = [fingerprint(t or b"", words) for part in slices(column.cast(pa.binary())) for t in part]
            yield pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, LongType())(text)


def _first_chains() -> list[tuple[int, int]]:
    """(start of the chain, bits that are equal) of the 16 keys: the two bytes at a start, and a half of the 24 bits after them."""
    bit = lambda start, n: 1 << (63 - (8 * start + n) % 64)
    return [(s, sum(bit(s, n) for n in (*range(16), *range(low, low + 12)))) for s in range(RING) for low in (16, 28)]


def _longer_chains(chains: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Four longer keys for each: of the bits left open at most three differ, so that one of four parts of them is equal."""
    longer = []
    for start, equal in chains:
        left = [b for b in range(64) if not equal >> b & 1]
        longer += [(start, equal | sum(1 << b for b in left[part::4])) for part in range(4)]
    return longer


#: The chains of each level of splitting; at the last one 12 bits or fewer are open, so that no key can be hot.
LEVELS = [_first_chains()]
for _ in range(4):
    LEVELS.append(_longer_chains(LEVELS[-1]))
CHAINS = [chain for level in LEVELS for chain in level]
FIRST_OF = [sum(len(level) for level in LEVELS[:k]) for k in range(len(LEVELS))]
STARTS = np.array([start for start, _ in CHAINS], np.int64)


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _ring_keys(fp: Column, ring: Column) -> Column:
    """The 16 keys of a fingerprint: number of the chain, which also tells the ring, and the fingerprint's bits in it."""
    path = lambda k: (ring * len(CHAINS) + k).cast("int")
    return F.array(*(F.struct(path(k).alias("path"), fp.bitwiseAND(_signed(equal)).alias("key")) for k, (_, equal) in enumerate(LEVELS[0])))


def _split_keys(fp: Column, path: Column, level: int) -> Column:
    """The four longer keys of a key of a level."""
    number = path % len(CHAINS) - FIRST_OF[level]
    ring = F.floor(path / len(CHAINS)) * len(CHAINS) + FIRST_OF[level + 1]
    bits = F.array(*(_signed(equal) for _, equal in LEVELS[level + 1]))
    return F.array(*(F.struct((ring + number * 4 + k).cast("int").alias("path"), fp.bitwiseAND(F.element_at(bits, (number * 4 + k + 1).cast("int"))).alias("key")) for k in range(4)))


def _chain_ok(differs: np.ndarray, start: int | np.ndarray) -> np.ndarray:
    """Which of the xors keep to the budgets along the ring from byte ``start``."""
    ok, total = np.ones(differs.shape, bool), np.zeros(differs.shape, np.uint8)
    for n in range(RING):
        shift = np.asarray(8 * ((RING - 1 - start - n) % RING), np.uint64)
        total += np.bitwise_count((differs >> shift) & np.uint64(0xFF))
        ok &= total <= BUDGET[n]
    return ok


class _Forest:
    """Union-find over positions; the smallest fingerprint of a tree is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _join_run(fps: np.ndarray, at: np.ndarray, start: int, forest: _Forest) -> None:
    """Join the positions ``at`` whose fingerprints are linked along the chain from ``start``, without listing all pairs."""
    if len(at) <= DIRECT:
        own = fps[at]
        for i in range(len(at) - 1):
            differs = own[i + 1 :] ^ own[i]
            near = np.flatnonzero(np.bitwise_count(differs) <= MAX_BITS)
            for j in near[_chain_ok(differs[near], start)] if len(near) else ():
                forest.join(int(at[i]), int(at[i + 1 + j]))
        return
    own = fps[at]
    varies = int(np.bitwise_or.reduce(own ^ own[0]))
    bits = [b for b in range(64) if varies >> b & 1]
    for part in range(4):  # three differences leave one of four parts equal
        mask = np.uint64(sum(1 << b for b in bits[part::4]))
        order = np.argsort(own & mask, kind="stable")
        cuts = np.flatnonzero(np.diff((own & mask)[order])) + 1
        for run in np.split(order, cuts):
            if len(run) > 1:
                _join_run(fps, at[np.sort(run)], start, forest)


def _links_of(paths: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Rows (ring, fingerprint, smaller fingerprint of its tree) for the rows of whole runs of equal (path, key)."""
    cuts = np.flatnonzero((np.diff(paths) != 0) | (np.diff(keys) != 0)) + 1
    begins, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
    rings, starts = paths // len(CHAINS), STARTS[paths % len(CHAINS)]
    two = begins[ends - begins == 2]
    differs = fps[two] ^ fps[two + 1]
    two = two[(np.bitwise_count(differs) <= MAX_BITS) & _chain_ok(differs, starts[two])]
    found = [np.stack([rings[two].astype(np.uint64), fps[two + 1], fps[two]], axis=1)]
    for k in np.flatnonzero(ends - begins > 2):
        a, z = int(begins[k]), int(ends[k])
        own, forest = fps[a:z], _Forest(z - a)
        _join_run(own, np.arange(z - a), int(starts[a]), forest)
        pairs = [(i, r) for i in range(z - a) if (r := forest.root(i)) != i]
        if pairs:
            i, r = np.array(pairs).T
            found.append(np.stack([np.full(len(pairs), rings[a], np.uint64), own[i], own[r]], axis=1))
    return np.concatenate(found)


LINK = "ring int, u bigint, v bigint"


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """The columns of sorted batches, cut so that no run of equal values of the first ``keys`` columns is divided."""
    held: list[pa.RecordBatch] = []
    key_at = lambda batch, k: [batch.column(i)[k].as_py() for i in range(keys)]

    def columns() -> list[pa.Array]:
        table = pa.Table.from_batches(held).combine_chunks()
        return [c.chunk(0) for c in table.columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for i in range(keys):
            own = batch.column(i).to_numpy(zero_copy_only=False)
            same &= own == own[-1]
        last = batch.num_rows - int(same.sum())
        goes_on = bool(held) and key_at(held[-1], held[-1].num_rows - 1) == key_at(batch, 0)
        if last or not goes_on:
            if last:
                held.append(batch.slice(0, last))
            if held:
                yield columns()
            held = []
        held.append(batch.slice(last))
    if held:
        yield columns()


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each run of equal (path, key); the input is sorted by (path, key, fp)."""
    for rows in whole_runs(batches, 2):
        paths, keys, fps = (c.to_numpy(zero_copy_only=False) for c in rows)
        found = _links_of(paths.astype(np.int64), keys, fps.view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int32()), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["ring", "u", "v"])


def ring_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct links (ring, u, v) of distinct fingerprints (ring, fp), whose transitive closure is that of all links within MAX_BITS in a ring.

    Keys with more than about ``hot`` fingerprints are split, again and again. They are found by counting the keys of one
    fingerprint in ``SOME``: a key that is split without need costs a little and loses nothing.
    """
    dealt = None
    keyed = prints.select("fp", F.explode(_ring_keys(F.col("fp"), F.col("ring"))).alias("k")).select("k.path", "k.key", "fp")
    for level in range(len(LEVELS) - 1):
        some = keyed.filter(F.pmod(F.xxhash64("fp"), F.lit(SOME)) == 0)
        full = stage(some.groupBy("path", "key").count().filter(F.col("count") > hot // (2 * SOME)).select("path", "key"), "hot-keys")
        if full.isEmpty():
            break
        full = small_or_shuffled(full)
        rest = keyed.join(full, ["path", "key"], "left_anti")
        dealt = rest if dealt is None else dealt.unionByName(rest)
        keyed = keyed.join(full, ["path", "key"], "left_semi").select("fp", F.explode(_split_keys(F.col("fp"), F.col("path"), level)).alias("k")).select("k.path", "k.key", "fp")
    dealt = keyed if dealt is None else dealt.unionByName(keyed)
    runs = dealt.repartition("path", "key").sortWithinPartitions("path", "key", "fp")
    return runs.mapInArrow(_bucket_links, LINK).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (u, v): its component's smallest node. Alternating star contraction.

    Large star: a node's larger neighbours move to its smallest neighbour. Small star: the smaller ones do. The result
    is a forest of stars once neither changes anything; the number of rounds grows with the logarithm of the size.
    """

    def signature(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = stage(links.filter("u != v"), "links")
    seen = signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), "links")
        now = signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    bounded_batches(docs)
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), words).alias("fp")), "fingerprints")
    reps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    trees = components(ring_links(reps.select(F.lit(0).alias("ring"), "fp"), hot).select("u", "v"))
    linked = reps.join(trees.toDF("fp", "root"), "fp").unionByName(reps.join(trees.select(F.col("root").alias("fp")).distinct(), "fp").withColumn("root", F.col("fp")))
    linked = stage(linked, "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = linked.join(least, "root").select("fp", "component_id")
    named = reps.join(merged, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """``docs`` with the document of smallest id of each group, all columns kept. Rows without an id stay."""
    groups = near_groups(docs, text, doc_id, words)
    drop = stage(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-copies")
    return without_ids(docs, drop, doc_id)

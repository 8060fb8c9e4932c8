"""Exact and near dedup against brute force on small tables."""

import hashlib
import random
import re

import pytest
import xxhash

from skein.llm import exact_dedup, similar, simhash

SCHEMA = "doc_id long, text string, n long, kept string, rid int, drop_id int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0, "x", 1, 2, "y") for d, t in rows], SCHEMA)


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \n"), (7, "c"), (7, "c"), (None, "c "), (8, "a  b "), (9, "é" * 5000), (10, "ab"), (11, "z"), (11, "y")]


def groups_by_hand(rows):
    by = {}
    for d, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d is None, d))
    return {k: (min(v)[2], len(v)) for k, v in by.items()}


@pytest.mark.parametrize("support", [1e-3, 0.15, 0.9])
def test_exact_groups(spark, support):
    found = exact_dedup.exact_groups(frame(spark, ROWS), support=support).collect()
    by_hand = groups_by_hand(ROWS)
    assert len(found) == len(ROWS)
    assert sum(r.kept for r in found) == len(by_hand)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in by_hand.items()}
    for r in found:
        assert (r.keep_id, r.group_size) == sha[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    docs = frame(spark, ROWS)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted([(False, 8, "a  b "), (False, 6, " \n"), (True, 0, "c "), (False, 9, "é" * 5000), (False, 11, "z"), (False, 11, "y")])
    again = exact_dedup.drop_copies(frame(spark, [(1, "q"), (1, "q"), (1, "q"), (2, "r")])).collect()
    assert sorted(r.doc_id for r in again) == [1, 2]
    # equal texts of one id: the longest stays, whatever order the texts have
    assert [r.text for r in exact_dedup.drop_copies(frame(spark, [(1, "ab"), (1, "a b")])).collect()] == ["a b"]


def test_drop_copies_of_ids_with_rows_that_stay_and_rows_that_go(spark):
    """What stays are the rows that are kept, also where an id or no id has several texts."""
    chance = random.Random(11)
    texts = ["a b", "ab", "a  b", "c", " c", "", None, " ", "d"]
    rows = [(chance.choice([None, 1, 2, 3, 4, 5, 6]), chance.choice(texts)) for _ in range(60)] + [(k, f"own {k}") for k in range(7, 12)] + [(12, "d"), (13, "c")]
    best = {}
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0d]+", "", text or "")
        best[key] = min(best.get(key, (1, True, 0)), (-len(text or ""), doc_id is None, doc_id or 0))
    out = exact_dedup.drop_copies(frame(spark, rows)).collect()
    assert sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in out) == sorted(best.values())


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []
    assert exact_dedup.drop_copies(frame(spark, [])).collect() == []
    assert simhash.near_groups(frame(spark, [])).collect() == []
    assert simhash.one_of_each(frame(spark, [])).collect() == []


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    chance = random.Random(3)
    for _ in range(200):
        text = "".join(chance.choice("aB cÉ\x0b\t\n\x85 d") for _ in range(chance.randint(0, 80)))
        assert simhash.fingerprint(text.encode()) == fingerprint_by_hand(text)


def components_by_hand(rows):
    prints = [fingerprint_by_hand(t or "") for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))]


def near_rows():
    chance = random.Random(5)
    vocabulary = ["".join(chance.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    rows = [(None, "x y"), (2, "x y"), (3, None), (4, " "), (5, "One two three four"), (6, "one TWO three four")]
    for d in range(100, 108):
        words = [chance.choice(vocabulary) for _ in range(400)]
        rows.append((d, " ".join(words)))
        for e in range(12):
            words[chance.randrange(len(words))] = chance.choice(vocabulary)
            rows.append((d * 100 + e, " ".join(words)))
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_near_groups(spark, hot):
    rows = near_rows()
    found = [tuple(r) for r in simhash.near_groups(frame(spark, rows), hot=hot).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found, key=order) == sorted(components_by_hand(rows), key=order)
    assert len({r[2] for r in found}) < len(rows) - 20


def test_dense_runs_are_joined_without_all_pairs(monkeypatch):
    """All 12-bit patterns around a value: one component, however the run is divided."""
    import numpy as np

    monkeypatch.setattr(simhash, "DIRECT", 16)
    base = 0x0123456789ABC000
    own = np.array(sorted(base | k for k in range(1 << 10)), np.uint64)
    links = simhash._links_of(np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), own)
    assert len(links) == len(own) - 1


def test_one_of_each(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    stays = [d for d, _, c in components_by_hand(rows) if d is None or d == c]
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == sorted((d is None, d) for d in stays)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(900, 901)], "u long, v long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert found == {**{k: 0 for k in range(1, 201)}, 901: 900}


def test_staged_tables_can_be_cleared(spark):
    from skein.llm import shared

    table = shared.stage(spark.range(3).toDF("x"), "test")
    path = shared._made[-1]
    assert table.count() == 3
    shared.clear_staged(spark)
    assert shared._made == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_slices():
    import pyarrow as pa

    from skein.llm import shared

    values = ["a" * 3_000_000, None, "b" * 5_000_000, "", "c", "d" * 2_000_000, "e" * 3_000_000]
    parts = list(shared.slices(pa.array(values)))
    assert [v for p in parts for v in p] == values
    assert [len(p) for p in parts] == [2, 1, 3, 1]
    assert list(shared.slices(pa.array([], pa.string()))) == []


def shingles_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def grouped(n, pairs):
    """The number of each item's group."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        up[root(i)] = root(j)
    return [root(i) for i in range(n)]


def similar_by_hand(rows):
    """The pairs of rows of similarity 0.8 or more, those of them that a ring makes candidates, and the smallest id of each row's group."""
    n, sets = len(rows), [shingles_by_hand(t) for _, t in rows]
    pairs = [(i, j) for i in range(n) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    rings = [similar.ring_fingerprints((t or "").encode().lower().split()).tolist() for _, t in rows]
    same = [grouped(n, [(i, j) for i in range(n) for j in range(i) if (rings[i][k] ^ rings[j][k]).bit_count() <= 3]) for k in range(similar.RINGS)]
    links = [(i, j) for i, j in pairs if sets[i] == sets[j] or any(g[i] == g[j] for g in same)]
    group, least = grouped(n, links), {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[group[i]] = min(d, least.get(group[i], d))
    return pairs, links, [least.get(g) for g in group]


def similar_rows():
    """Texts of similarities around 0.8, chains of copies, a large group, short and empty texts."""
    chance = random.Random(11)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(5))
    rows = [(None, "x y"), (2, "X  y"), (3, None), (4, " "), (5, "one two three four"), (6, "one TWO three four"), (7, "one two three five")]
    for d in range(100, 130):
        words = [word() for _ in range(chance.randint(30, 200))]
        rows.append((d, " ".join(words)))
        for e in range(40 if d == 100 else 4):
            copy = list(words)
            for _ in range(max(1, round(len(words) * chance.choice((0.01, 0.02, 0.025, 0.03))))):
                copy[chance.randrange(len(copy))] = word()
            rows.append((d * 100 + e, " ".join(copy)))
            words = copy if d % 2 else words
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "chunk"), [(simhash.HOT, similar.CHUNK), (1, 6)])
def test_similar_groups(spark, hot, chunk, monkeypatch):
    monkeypatch.setattr(similar, "SHARED", 2)
    rows = similar_rows()
    pairs, links, by_hand = similar_by_hand(rows)
    found = [tuple(r) for r in similar.similar_groups(frame(spark, rows), hot=hot, chunk=chunk).collect()]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(found, key=order) == sorted(((d, c) for (d, _), c in zip(rows, by_hand, strict=True)), key=order)
    far = [p for p in pairs if (fingerprint_by_hand(rows[p[0]][1] or "") ^ fingerprint_by_hand(rows[p[1]][1] or "")).bit_count() > 3]
    assert len(far) > 100
    assert len(links) > 0.95 * len(pairs)
    assert similar.similar_groups(frame(spark, [])).collect() == similar.one_of_each(frame(spark, [])).collect() == []


def test_the_parity_check_loses_no_pair():
    import numpy as np

    chance = np.random.default_rng(4)
    for _ in range(300):
        n = int(chance.integers(1, 3000))
        whole = chance.integers(0, 1 << 64, n + n // 4, np.uint64)
        own, other = np.unique(whole[: n - n // 9 + 1]), np.unique(np.r_[whole[: n - n // 9], whole[n : n + n // 12]])
        both = len(np.intersect1d(own, other))
        ok = similar.may_link(*(np.frombuffer(similar.parities(own), np.uint64)[None], np.array([len(own)])), np.frombuffer(similar.parities(other), np.uint64), len(other))
        assert ok[0] or 5 * both < 4 * (len(own) + len(other) - both)


def test_pairs_of_groups():
    import numpy as np

    chance = np.random.default_rng(6)
    base = chance.integers(0, 1 << 64, 300, np.uint64)
    sets = [np.unique(np.r_[base[int(chance.integers(0, 80)) :], chance.integers(0, 1 << 64, int(chance.integers(1, 30)), np.uint64)]) for _ in range(60)]
    n, parity = np.array([len(s) for s in sets]), np.stack([np.frombuffer(similar.parities(s), np.uint64) for s in sets])
    passing = [(i, j) for i in range(60) for j in range(60) if i != j and similar.may_link(parity[[i]], n[[i]], parity[j], n[j])[0]]
    spanning = similar.spanning_pairs(n, parity)
    assert set(spanning) <= set(passing)
    names = lambda g: [min(i for i in range(60) if g[i] == x) for x in g]
    assert names(grouped(60, spanning)) == names(grouped(60, passing))
    tree = chance.integers(0, 4, 60)
    cross = similar.cross_pairs(n, parity, tree)
    assert sorted(map(frozenset, cross), key=sorted) == sorted({frozenset(p) for p in passing if tree[p[0]] != tree[p[1]]}, key=sorted)


def test_runs_across_batches():
    import numpy as np
    import pyarrow as pa

    keys, parts = np.repeat(np.arange(6), [1, 9, 2, 7, 1, 3]), np.zeros(23, int)
    parts[5:10] = 1
    for size in (1, 2, 3, 5, 50):
        batches = [pa.record_batch([pa.array(keys[k : k + size]), pa.array(parts[k : k + size]), pa.array(np.arange(k, min(k + size, 23)))], names=list("abc")) for k in range(0, 23, size)]
        out = [[c.to_pylist() for c in run] for run in simhash.whole_runs(iter([*batches, batches[0].slice(0, 0)]), 2)]
        assert [x for run in out for x in run[2]] == list(range(23))
        seen = [set(zip(run[0], run[1], strict=True)) for run in out]
        assert sum(len(s) for s in seen) == len(set().union(*seen)) == 7


def test_the_pipeline_drops_similar_texts(spark):
    import corpus_pipeline

    rows = similar_rows()
    docs = frame(spark, rows)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    stays = [d for (d, _), c in zip(rows, similar_by_hand(rows)[2], strict=True) if d is None or d == c]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((d is None, d or 0) for d in stays)

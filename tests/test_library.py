"""Operators against small definitions, and known values."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import bits, hashes
from skein.functions.bins import linear, logarithmic, square_root
from skein.operators import counts, hist, moving, order, setops, sketch, stats, tables, tdigest
from skein.sources import text
from skein.streaming import running


def column(spark, values, kind="string", name="k"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) if names else tuple(r)) for r in df.collect())


# ---- counts, top-k


def test_most_common_breaks_ties_by_the_greater_key(spark):
    found = counts.most_common(column(spark, "abccdeefgggh"), "k", 3).collect()
    assert [tuple(r) for r in found] == [("g", 3), ("e", 2), ("c", 2)]


def test_counter_drops_zero_sums_and_merges(spark):
    updates = spark.createDataFrame([(2, 1), (3, 1), (3, 1), (2, -1), (1, 1)], "k int, a int")
    found = counts.counter(updates, "k", "a")
    assert rows(found) == [(1, 1), (3, 2)]
    assert [tuple(r) for r in counts.top_by_value(found, "k", "cnt", 1).collect()] == [(3, 2)]
    assert rows(counts.merge(found, spark.createDataFrame([(1, -1), (4, 7)], "k int, cnt long"), "k")) == [(3, 2), (4, 7)]


def test_top_k(spark):
    values = list(range(100))
    random.Random(1).shuffle(values)
    assert [r.k for r in counts.top_k(column(spark, values, "int"), "k", 7, ascending=True).collect()] == list(range(93, 100))
    groups = spark.createDataFrame([(k % 3, k, k // 10) for k in values], "g int, k int, v int")
    found = counts.top_in_groups(groups, "g", "k", "v", 2)
    assert rows(found, "g", "k") == sorted((g, k) for g in range(3) for k in sorted((x for x in values if x % 3 == g), key=lambda x: (x // 10, x))[-2:])


@pytest.mark.parametrize(("n", "size"), [(0, 4), (2, 2), (-2, 2), (-1, 0)])
def test_line_frequency(spark, n, size):
    lines = text.lines(spark.createDataFrame([("a\nb\na",), ("c\n",), ("",), (None,)], "text string"))
    assert counts.line_frequency(lines, n=n).count() == size


def test_frecency_equals_decay(spark):
    keys = [random.Random(2).choice("abc") for _ in range(60)]
    keys = [random.Random(k).choice("abc") for k in range(60)]
    weights = dict.fromkeys("abc", 0.0)
    for k in keys:
        weights = {x: w * 0.9 for x, w in weights.items()}
        weights[k] += 1
    df = spark.createDataFrame(list(enumerate(keys)), "t int, k string")
    for r in counts.frecency(df, "k", ["t"], 0.9).collect():
        assert math.isclose(r.weight, weights[r.k], rel_tol=1e-9) and math.isclose(r.share, weights[r.k] / sum(weights.values()), rel_tol=1e-9)


def test_counts_of_empty_tables(spark):
    empty = column(spark, [])
    assert counts.most_common(empty, "k").collect() == []
    assert tuple(counts.summary(empty, "k").first()) == (0, 0, 0)
    assert counts.shares(counts.frequency(empty, "k"), "k").collect() == []


# ---- text


def test_scans(spark, tmp_path):
    df = spark.createDataFrame([("It's the Kelvin-sign, x2y\tZ\x01z",)], "text string")
    assert [r.word for r in text.words_alphabetic(df).collect()] == ["it", "s", "the", "elvin", "sign", "x", "y", "z", "z"]
    assert [r.word for r in text.words_between(df).collect()] == ["It", "s", "the", "Kelvin", "sign", "x", "y", "Z\x01z"]
    assert [r.word for r in text.words_visible(df).collect()] == ["it's", "the", "Kelvin-sign,", "x2y", "z", "z"]
    (tmp_path / "r.txt").write_bytes(b"a;b;;a")
    assert [r.line for r in text.read_records(spark, str(tmp_path / "r.txt"), ";").collect()] == ["a", "b", "", "a"]
    own = [1, -1, 2**63 - 1, -(2**63), 0]
    (tmp_path / "h.bin").write_bytes(struct.pack("<5q", *own))
    (tmp_path / "e.bin").write_bytes(b"")
    assert sorted(r.h for r in text.read_hashes(spark, str(tmp_path / "*.bin")).collect()) == sorted(own)


def test_sinks_and_saved_tables(spark, tmp_path):
    c = spark.createDataFrame([("a", 3), ("b", 1)], "key string, count long")
    text.write_formatted(c.coalesce(1), str(tmp_path / "out"), "@f @k=@c")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0.250000000 b=1", "0.750000000 a=3"]
    numbers = spark.createDataFrame([(1981.0,), (100000.0,), (1234567.0,), (0.5,), (1e6,)], "x double").select(text.six_digits(F.col("x")).alias("s"))
    assert [r.s for r in numbers.collect()] == [f"{x:.6g}" for x in (1981.0, 100000.0, 1234567.0, 0.5, 1e6)]
    text.save(c, str(tmp_path / "saved"))
    assert rows(text.open_saved(spark, str(tmp_path / "saved"))) == rows(c)
    assert text.rendered(c, "key", "count") == "{a: 3, b: 1}" and text.rendered(c, "key") == "{a, b}"
    assert rows(text.from_keys(spark, "aab", "string")) == [("a",), ("b",)]
    assert rows(text.from_pairs(spark, [("a", 1), ("a", 2)], "string", "int"), "key", "value") == [("a", 2)]


# ---- tables and sets


def test_tables(spark):
    t = spark.createDataFrame([(1, "x", 0), (2, "y", 1)], "k int, v string, ord int")
    more = spark.createDataFrame([(2, "z", 0), (3, "w", 1), (3, "u", 2)], "k int, v string, ord int")
    assert rows(tables.upsert(t, more, "k", "v", "ord")) == [(1, "x"), (2, "z"), (3, "u")]
    keys = column(spark, [1, 9, 9], "int")
    assert rows(tables.get(t, keys, "k", "v", F.lit("none"))) == [(1, "x"), (9, "none"), (9, "none")]
    with pytest.raises(Exception, match="no such key"):
        tables.get(t, keys, "k", "v", required=True).collect()
    assert rows(tables.contains(t, keys, "k")) == [(1, True), (9, False), (9, False)]
    assert rows(tables.get_or_put(t.select("k", "v"), keys, "k", "v", F.lit("new"))) == [(1, "x", True), (2, "y", True), (9, "new", False)]
    assert rows(tables.edit_or_init(t, keys, "k", "v", F.upper, F.lit("i"))) == [(1, "X"), (2, "y"), (9, "i")]
    assert rows(tables.delete_one(column(spark, "aab"), column(spark, "ac"))) == [("a",), ("b",)]
    out, left = tables.take(t, keys, "k")
    assert (rows(out, "k"), rows(left, "k")) == ([(1,)], [(2,)])
    assert tables.pop_last(t, "ord").first().k == 2
    assert [tables.nth(t, "ord", n).collect() and tables.nth(t, "ord", n).first().k for n in (0, 1, -1, -2, 2)] == [1, 2, 2, 1, []]
    assert rows(tables.map_set(column(spark, [1, 2, 3], "int"), "k", lambda x: x % 2)) == [(0,), (1,)]
    assert rows(tables.index_by(t, lambda f: f.length("v"), "ord")) == [(1, 2, "y", 1)]
    assert rows(tables.all_values(more, "k", "v", "ord")) == [(2, ["z"]), (3, ["w", "u"])]
    assert rows(tables.multiplicity(more, "k")) == [(2, 1), (3, 2)]
    assert rows(tables.first_of_each(more, "k", "ord"), "k", "v") == [(2, "z"), (3, "w")]
    assert tables.in_universe(t, "k", 0, 7).count() == 2
    with pytest.raises(Exception, match="outside"):
        tables.in_universe(t, "k", 2, 7).collect()


def test_renamed_counters_keep_their_place(spark):
    arrivals = spark.createDataFrame(list(enumerate([2, 3, 4, 5, 6, 7, 9, 9])), "ord int, k int")
    t = arrivals.groupBy("k").agg(F.count(F.lit(1)).alias("cnt"), F.min("ord").alias("ord"))
    t = tables.edit_key(t, "k", 9, 8)
    assert tuple(tables.nth(t, "ord", 6).select("k", "cnt").first()) == (8, 2)
    assert tuple(tables.nth(t, "ord", 0).select("k", "cnt").first()) == (2, 1)


def test_anagrams(spark):
    found = tables.anagrams(column(spark, ["tea", "ate", "eat", "tan", "eat"], name="word"))
    assert rows(found) == [("aet", 3, "ate eat tea")]


def test_sets(spark):
    a, b = column(spark, "aabc"), column(spark, "bcd")
    assert rows(setops.union(a, b)) == [("a",), ("a",), ("b",), ("c",), ("d",)]
    assert rows(setops.intersection(a, b)) == [("b",), ("c",)]
    assert rows(setops.difference(a, b)) == [("a",)]
    assert rows(setops.symmetric_difference(a, b)) == [("a",), ("d",)]
    empty = column(spark, "")
    for x, y, expected in [(a, b, (False, False, False, False)), (a, a, (False, True, False, True)), (column(spark, "ab"), a, (False, True, True, False)), (a, column(spark, "abc"), (False, False, False, False)), (empty, a, (True, True, True, False)), (empty, empty, (True, True, False, True))]:
        assert tuple(setops.compare(x, y).first()) == expected
    t = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "k int, v string, ord int")
    swapped = spark.createDataFrame([(1, "y", 0), (1, "x", 1)], "k int, v string, ord int")
    assert setops.equal_tables(t, t, "k", "v", "ord").first()[0] and not setops.equal_tables(t, swapped, "k", "v", "ord").first()[0]


# ---- histograms


def test_quantiles_equal_interpolation(spark):
    chance = random.Random(3)
    data = [(g, chance.randint(0, 9)) for g in "ab" for _ in range(50)] + [("c", 4)]
    h = hist.histogram(spark.createDataFrame(data, "g string, x int"), F.col("x"), ["g"])
    qs = (0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0)
    for r in hist.quantiles(h, qs, ["g"]).collect():
        values, n = np.unique([x for g, x in data if g == r.g], return_counts=True)
        assert math.isclose(r.value, np.interp(r.q * n.sum(), n.cumsum() - n / 2, values), abs_tol=1e-12)
    assert math.isnan(hist.quantiles(h, (1.5,), ["g"]).first().value)


def test_small_histogram(spark):
    h = hist.histogram(column(spark, [0, 2, 4, 4, 4, 6, 6, 6, 6, 8], "int"), F.col("k"))
    assert rows(hist.distribution(h), "bin", "pmf", "cdf") == [(0, 1, 1), (2, 1, 2), (4, 3, 5), (6, 4, 9), (8, 1, 10)]
    assert [r.bin for r in hist.inverse_cdf(h, range(1, 11)).orderBy("s").collect()] == [0, 2, 4, 4, 4, 6, 6, 6, 6, 8]
    assert tuple(hist.extremes(h).first()) == (0, 8)
    taken = hist.histogram(column(spark, [4, 8], "int"), F.col("k"), weight=F.lit(-1))
    assert rows(hist.merge([h, taken])) == [(0, 1), (2, 1), (4, 2), (6, 4)]
    with pytest.raises(ValueError, match="different"):
        hist.merge([h, h], [linear(1, 2, 3), linear(1, 2, 4)])


@pytest.mark.parametrize("bins", [logarithmic(0.125, 10, 8), square_root(0.25, 9, 20), linear(0.5, 10, 12)])
def test_bins(spark, bins):
    indexes = spark.range(2 * bins.n + 1).select(F.col("id").cast("int").alias("i"))
    back = indexes.filter(f"i between 1 and {2 * bins.n - 1}").select("i", bins.index(bins.value(F.col("i"))).alias("j"), *(e.alias(n) for n, e in zip(("low", "high"), bins.edges(F.col("i")), strict=True)), bins.value(F.col("i")).alias("v"))
    for r in back.collect():
        assert r.i == r.j and r.low < r.v < r.high
    values = [-12.0, -10.0, -0.01, 0.0, 0.01, 10.0, 12.0, float("nan"), None]
    found = [r.b for r in column(spark, values, "double").select(bins.index(F.col("k")).alias("b")).collect()]
    assert found[2:5] == [bins.n] * 3 and found[0] == 0 and found[6] == 2 * bins.n and found[7:] == [None, None]
    counted = hist.underflow_overflow(column(spark, values, "double"), F.col("k"), bins).first()
    assert counted.zeros == 3 and counted.total == 7


def test_gaussian_quantiles(spark):
    data = np.random.default_rng(1).normal(size=20_000)
    bins = logarithmic(1e-6, 1e3, 4000)
    qs = (0.01, 0.1587, 0.5, 0.8413, 0.99)
    found = {r.q: r.value for r in hist.binned_quantiles(column(spark, data.tolist(), "double"), F.col("k"), bins, qs).collect()}
    for q in qs:
        assert abs(found[q] - np.quantile(data, q)) < 0.02
    sketched = {r.q: r.value for r in sketch.sketched_quantiles(column(spark, data.tolist(), "double"), "k", qs).collect()}
    for q in qs:
        assert abs((data <= sketched[q]).mean() - q) < 0.02


def test_digests(spark):
    data = np.random.default_rng(2).normal(size=8000)
    df = spark.createDataFrame([("ab"[k % 2], float(x)) for k, x in enumerate(data)] + [("a", None)], "g string, x double")
    digests = tdigest.digest(df, "x", ["g"]).cache()
    assert all(len(r.centroids) < 250 for r in digests.collect()) and [r.weight for r in tdigest.weight(digests).collect()] == [4000.0, 4000.0]
    whole = tdigest.merge(digests.select("centroids"))
    for r in tdigest.quantiles(whole, (0.0, 0.001, 0.05, 0.5, 0.95, 0.999, 1.0)).collect():
        assert abs((data <= r.value).mean() - r.q) < 0.005
        assert r.q not in (0.0, 1.0) or r.value == np.quantile(data, r.q)
    for r in tdigest.cdf(whole, (-9.0, -1.0, 0.0, 2.0, 9.0)).collect():
        assert abs((data <= r.x).mean() - r.share) < 0.005
    assert tdigest.digest(df.filter("g = 'c'"), "x", ["g"]).collect() == []
    with pytest.raises(ValueError, match="0..1"):
        tdigest.quantiles(whole, (2.0,))
    with pytest.raises(Exception, match="NaN"):
        tdigest.digest(column(spark, [float("nan")], "double"), "k").collect()


def test_hashes(spark):
    rows_ = spark.range(2000).select(hashes.salted(F.col("id")).alias("a"), hashes.salted(F.col("id"), 1).alias("b"), hashes.unit(F.col("id")).alias("u"), hashes.bucket(F.col("id"), 7).alias("p"), hashes.masked(F.col("id"), 8).alias("m"), hashes.identity(F.col("id")).alias("i")).collect()
    assert len({r.a for r in rows_}) == 2000 and all(r.a != r.b for r in rows_) and all(0 <= r.u < 1 for r in rows_)
    assert abs(np.mean([r.u for r in rows_]) - 0.5) < 0.03 and {r.p for r in rows_} == set(range(7)) and {r.m for r in rows_} <= set(range(256)) and [r.i for r in rows_] == list(range(2000))


def test_cumulative_sums(spark):
    df = spark.createDataFrame([(1, 5), (2, -2), (3, 4)], "t int, v int")
    assert rows(hist.cumulative(df, "t", "v"), "cumsum") == [(3,), (5,), (7,)]
    found = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],)], "a array<double>").select(hist.cumulative_array(F.col("a")).alias("c"))
    assert [r.c for r in found.collect()] == [[1.0, 3.0, 7.0], []]


# ---- moments

OFFSET = [10000001.0, 10000002.0, 10000001.0, 10000004.0, 10000001.0, 10000004.0, 10000001.0, 10000002.0]


def test_moments(spark):
    df = column(spark, OFFSET, "double")
    m = stats.moments(df, "k").first()
    assert m.mean == 10000002 and math.isclose(m.variance, 1.5, rel_tol=1e-8) and math.isclose(m.sdev, 1.22474487, rel_tol=1e-8)
    assert math.isclose(m.skew, 0.81649658, rel_tol=1e-7) and math.isclose(m.kurt, -1, rel_tol=1e-7)
    s = stats.sample_moments(df, "k").first()
    assert math.isclose(s.variance_s, 12 / 7, rel_tol=1e-8)
    assert tuple(stats.sample_moments(df.limit(1), "k").first())[1:] == (0.0, 0.0, 0.0, 0.0)


def test_merged_statistics(spark):
    df = spark.createDataFrame([(k % 3, float(k * k)) for k in range(20)], "g int, x double")
    merged, whole = stats.merge(stats.basic(df, "x", ["g"])).first(), stats.basic(df, "x").first()
    for name in ("n", "least", "greatest", "mean", "sdev"):
        assert math.isclose(merged[name], whole[name], rel_tol=1e-12)


def test_moving_statistics(spark):
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(OFFSET)], "s string, t int, x double")
    for r in stats.moving(df, "x", ["s"], ["t"], 3).collect():
        own = np.array(OFFSET[max(0, r.t - 2) : r.t + 1])
        assert r.n == len(own) and math.isclose(r.mean, own.mean()) and math.isclose(r.variance, max(own.var(), 1e-30 * own.mean() ** 2), rel_tol=1e-6, abs_tol=1e-7)
        assert (r.least, r.greatest, r.least_ever, r.greatest_ever) == (own.min(), own.max(), min(OFFSET[: r.t + 1]), max(OFFSET[: r.t + 1]))


def weights_of(kernel, n, old):
    return {"flat": [1.0] * n, "linear": [k + 1.0 for k in range(n)], "exponential": [old ** (n - 1 - k) for k in range(n)]}[kernel]


@pytest.mark.parametrize("kernel", ["flat", "linear", "exponential"])
def test_moving_quantiles(spark, kernel):
    chance = random.Random(4)
    data = [("s", k, float(chance.randint(1, 7))) for k in range(30)]
    bins = linear(0.5, 10.5, 11)
    df = spark.createDataFrame(data, "s string, t int, x double")
    found = moving.moving_quantiles(df, "x", bins, (0.3, 0.5), ["t"], ["s"], ["t"], 5, kernel, 0.8).collect()
    assert len(found) == 60
    for r in found:
        own = [x for _, _, x in data[max(0, r.t - 4) : r.t + 1]]
        weight = {}
        for x, w in zip(own, weights_of(kernel, len(own), 0.8), strict=True):
            weight[x] = weight.get(x, 0) + w
        keys = sorted(weight)
        # a whole number lies in the middle of its bin
        assert math.isclose(r.value, moving.interpolated(np.array(keys), np.array([weight[k] for k in keys]), r.q), rel_tol=1e-9)


@pytest.mark.parametrize("win", [None, 6])
def test_running_quantiles_equal_their_definition(spark, win):
    chance = random.Random(5)
    data = [(s, k, chance.randint(0, 5)) for s in "ab" for k in range(25)]
    df = spark.createDataFrame(data, "s string, t int, b int")
    found = moving.running_quantiles(df, "b", [10.0 * k for k in range(6)], F.col("b"), 0.5, ["t"], ["s"], ["t"], 0.7, win)
    for r in found.collect():
        own = [b for s, k, b in data if s == r.s and k <= r.t][-(win or 10**6) :]
        weight = np.zeros(6)
        for k, b in enumerate(own):
            weight[b] += 0.7 ** (len(own) - 1 - k)
        assert math.isclose(r.value, moving.interpolated(np.arange(6) * 10.0, weight, 0.5), rel_tol=1e-6, abs_tol=1e-6)


def test_decayed_histogram_and_median(spark):
    df = spark.createDataFrame([("s", k, k % 2) for k in range(6)], "s string, t int, b int")
    found = {r.bin: r.cnt for r in moving.decayed_histogram(df, F.col("b"), ["s"], ["t"], 0.5).collect()}
    assert math.isclose(found[1], 1 + 0.25 + 0.0625) and math.isclose(found[0], 0.5 + 0.125 + 0.03125)
    values = [5, 1, 4, 2, 3]
    median = moving.moving_median(spark.createDataFrame([("s", k, x) for k, x in enumerate(values)], "s string, t int, x int"), "x", ["s"], ["t"], 3).orderBy("t")
    assert [r.median for r in median.collect()] == [sorted(values[max(0, k - 2) : k + 1])[min(k + 1, 3) // 2] for k in range(5)]


# ---- order


@pytest.mark.parametrize("range_rows", [order.RANGE_ROWS, 10])
def test_positions_over_ranges(spark, range_rows):
    chance = random.Random(6)
    data = [(chance.choice([None, 1, 1, 1, 2, 3, 50]), k) for k in range(120)]
    found = order.positions(spark.createDataFrame(data, "x int, k int"), ["x", "k"], "place", range_rows).collect()
    expected = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.x, r.k) for r in sorted(found, key=lambda r: r.place)] == expected and sorted(r.place for r in found) == list(range(1, 121))


@pytest.mark.parametrize("range_rows", [order.RANGE_ROWS, 10])
def test_running_sums_over_ranges(spark, range_rows):
    data = [(k * 7 % 101, k % 5 - 1) for k in range(101)]
    found = order.running_sum(spark.createDataFrame(data, "k int, w int"), ["k"], "w", "upto", range_rows).collect()
    assert {r.k: r.upto for r in found} == {k: sum(w for j, w in data if j <= k) for k, _ in data}


def test_ranked_access(spark):
    df = column(spark, [3, 1, 2, 2], "int")
    assert [order.nth(df, ["k"], n).first().k for n in (0, 1, 2, 3, -1, -4)] == [1, 2, 2, 3, 3, 1]
    assert rows(order.weighted_nth(spark.createDataFrame([(1, 2), (5, 3)], "k int, w int"), "k", "w", (0, 1, 2, 4, 5))) == [(0, 1), (1, 1), (2, 5), (4, 5)]
    assert tuple(order.seek(df, "k", 2).first()) == (True, 2) and tuple(order.seek(df, "k", 9).first()) == (False, None)
    assert tuple(order.extremes(df, "k").first()) == (1, 3)
    pairs = [(r.k, r.before, r.after) for r in order.neighbours(column(spark, [3, 1, 2], "int"), ["k"], "k").orderBy("k").collect()]
    assert pairs == [(1, None, 2), (2, 1, 3), (3, 2, None)]


def test_merges_and_sorts(spark):
    inputs = [column(spark, v, "int") for v in ([], [3], [1, 5], [2, 4, 6, 3])]
    merged = order.merge(inputs, "k").orderBy("place").collect()
    assert [(r.k, r.source) for r in merged] == [(1, 2), (2, 3), (3, 1), (3, 3), (4, 3), (5, 2), (6, 3)]
    people = spark.createDataFrame([(3.0, 50, 0), (6.0, 30, 1), (5.0, 30, 2)], "f double, age int, ord int")
    assert [(r.f, r.age) for r in order.stable_sort(people, ["age", "f"], "ord").collect()] == [(5.0, 30), (6.0, 30), (3.0, 50)]
    assert [r.ord for r in order.stable_sort(people, ["age"], "ord", ["age"]).collect()] == [0, 1, 2]
    assert [r.ord for r in order.stable_sort(people, ["age"], "ord", ["ord"]).collect()] == [2, 1, 0]
    assert tables.clear(people).count() == 0


def test_series(spark):
    df = spark.createDataFrame([("s", k, k) for k in range(1, 10)], "s string, t int, x0_ int")
    pairs = order.succeeding(df, "x0_", ["t"], ["s"])
    assert [r.diff for r in order.diffs(pairs).collect()] == [1] * 8
    ratios = {r.t: (r.ratio, r.ret) for r in order.diffs(pairs).collect()}
    assert ratios[2] == (2.0, 1.0) and ratios[3] == (1.5, 0.5)
    assert rows(order.succeeding(df, "x0_", ["t"], ["s"], 4), "x0", "x") == [(1, 5), (5, 9)]
    assert rows(order.succeeding(df, "x0_", ["t"], ["s"], 4, overlapping=True), "x0", "x") == [(k, k + 4) for k in range(1, 6)]
    assert [r.diff2 for r in order.second_diffs(df, "x0_", ["t"], ["s"]).collect()] == [0] * 7
    zero = spark.createDataFrame([("s", 1, 0), ("s", 2, 5)], "s string, t int, v int")
    assert order.diffs(order.succeeding(zero, "v", ["t"], ["s"])).first().ratio is None


# ---- exact quantiles, digests where rows lie


def exchanges_below(df, operator):
    """Whether the first ``operator`` of the plan, counted from the scan, has an exchange below it."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    planned = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert operator in plan and operator in planned
    return "Exchange" in planned[planned.rindex(operator) :]


def test_digests_are_built_where_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(tdigest, "HELD", 1000, raising=False)
    data = np.random.default_rng(5).normal(size=30_000)
    df = spark.createDataFrame([(None if k % 3 == 2 else k % 3, float(x)) for k, x in enumerate(data)], "g int, x double").repartition(3)
    digests = tdigest.digest(df.sortWithinPartitions("x"), "x", ["g"])
    assert not exchanges_below(tdigest.digest(spark.range(9), "id"), "MapInArrow")
    found = {(r.g, r.q): r.value for r in tdigest.quantiles(digests, (0.0, 0.01, 0.5, 0.99, 1.0), ["g"]).collect()}
    assert len(found) == 15
    for (g, q), value in found.items():
        own = data[2 if g is None else g :: 3]
        assert abs((own <= value).mean() - q) < 0.01 and (q not in (0.0, 1.0) or value == np.quantile(own, q))
    many = spark.range(3000).select((F.col("id") % 500).alias("g"), F.array(F.col("id") % 7).alias("a"), F.col("id").cast("double").alias("x"))
    assert {r.weight for r in tdigest.weight(tdigest.digest(many, "x", ["g"])).collect()} == {6.0}
    assert tdigest.digest(many, "x", ["a"]).count() == 7 and tdigest.weight(tdigest.digest(many, "x")).first().weight == 3000


@pytest.mark.parametrize("range_rows", [7, 100, 10**6])
def test_exact_quantiles_by_ranges(spark, range_rows):
    chance, qs = random.Random(11), (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    data = {g: [chance.randint(-60, 60) / 4 for _ in range(n)] for g, n in ((None, 1), ("a", 2), ("b", 333), ("c", 90))}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g string, x double").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    found = order.weighted_quantiles(df, "x", "n", qs, ["g"], range_rows).collect()
    assert len(found) == 4 * len(qs) and all(math.isclose(r.value, np.quantile(data[r.g], r.q), abs_tol=1e-12) for r in found)
    whole = order.weighted_quantiles(df.groupBy("x").agg(F.sum("n").alias("n")), "x", "n", qs, range_rows=range_rows).collect()
    assert {r.q: r.value for r in whole} == pytest.approx({q: np.quantile([x for xs in data.values() for x in xs], q) for q in qs})


def test_only_ranges_that_hold_a_quantile_are_shuffled(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("n"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where values are many
    try:
        found = order.weighted_quantiles(df, "x", "n", (0.5,), ["g"], 100)
        planned = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in planned and "SortMergeJoin" not in planned
        assert rows(found) == [(0, 0.5, 1999.0), (1, 0.5, 2000.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_places_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(order, "BROADCAST_RANGES", 3)
    df = spark.range(600).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), F.lit(2).alias("n"))
    found = order.weighted_quantiles(df, "x", "n", (0.0, 0.5, 1.0), ["g"], 50)
    assert rows(found) == [(g, q, np.quantile(np.repeat(np.arange(g, 600.0, 3), 2), q)) for g in range(3) for q in (0.0, 0.5, 1.0)]


@pytest.mark.parametrize(("name", "qs"), [("kll_quantiles", (0.01, 0.25, 0.5, 0.75, 0.99)), ("tdigest_quantiles", (0.0, 0.01, 0.5, 0.99, 1.0))])
def test_no_task_holds_a_groups_values(spark, tmp_path, name, qs):
    from skein.plans import registry

    data = {flag: [round(x, 2) for x in np.random.default_rng(k).uniform(900, 9000, 400).tolist()] for k, flag in enumerate(("A", "N", None))}
    spark.createDataFrame([(flag, x) for flag, xs in data.items() for x in xs], "l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES[name](spark, str(tmp_path))
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.l_returnflag, r.q) for r in found.collect()} == {(flag, q) for flag in data for q in qs}
    assert all(r.ok and abs(r.exact - np.quantile(data[r.l_returnflag], r.q)) < 0.0051 for r in found.collect())


# ---- sketches, bits


def test_count_min_never_underestimates(spark):
    chance = random.Random(7)
    data = [chance.randint(-50, 400) for _ in range(3000)]
    df = column(spark, data, "long")
    grid = sketch.count_min_merge([sketch.count_min(df.filter(f"k % 2 = {k}"), "k", 64) for k in (0, 1, -1)])
    found = {r.k: r.estimate for r in sketch.count_min_estimate(grid, df.union(column(spark, [9999], "long")), "k", 64).collect()}
    assert all(found[k] >= data.count(k) for k in set(data)) and len(found) == len(set(data)) + 1
    weighted = spark.createDataFrame([(k, 32 - k) for k in range(32)], "k long, a int")
    alone = sketch.count_min_estimate(sketch.count_min(weighted, "k", 4096, amount=F.col("a")), weighted, "k", 4096)
    assert sum(r.estimate == 32 - r.k for r in alone.collect()) >= 30


def test_heavy_hitters(spark):
    df = spark.createDataFrame([(k,) for k in range(40) for _ in range(40 - k)], "k long")
    assert [r.k for r in sketch.heavy_hitters(df, "k", 3).collect()] == [2, 1, 0]


def test_heavy_hitters_are_exact_for_more_keys_than_are_tracked(spark, tmp_path):
    from skein.plans import registry

    # 30,000 keys of two rows each, and twelve with up to eleven more
    df = spark.range(60_000).select((F.col("id") % 30_000).alias("l_suppkey")).union(spark.sql("SELECT 7 * k FROM (SELECT explode(sequence(1, 12)) AS k) LATERAL VIEW explode(sequence(1, k)) AS n"))
    df.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(registry.QUERIES["approx_heavy_hitters"](spark, str(tmp_path))) == [(k, 15 - k) for k in range(1, 11)]
    for width in (4, 1 << 16):  # the sketch tells of three keys, and cells of several keys lie above the floor
        skewed = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN id % 5 ELSE id END AS k").union(spark.sql("SELECT CAST(NULL AS long) FROM range(605)"))
        assert [tuple(r) for r in sketch.verified_hitters(skewed, "k", 3, 64, width).collect()] == [(None, 605), (0, 600), (1, 600)]
    zeros = column(spark, [0.0, -0.0, 0.0, -0.0, 1.0, 1.0, 1.0, 2.0], "double")
    assert [tuple(r) for r in sketch.verified_hitters(zeros, "k", 2).collect()] == [(0.0, 4), (1.0, 3)]
    assert sketch.verified_hitters(zeros, "k", 9).count() == 3 and sketch.verified_hitters(zeros.limit(0), "k", 9).count() == 0


def test_distinct_and_similarity(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    least = sketch.minimum_values(df.union(df), "k", 1024)
    found = sketch.minimum_values_estimate(least, 1024).first()
    assert abs(found.n_unique / 20_000 - 1) < 4 / math.sqrt(1023)
    assert sketch.minimum_values_estimate(sketch.minimum_values(df.limit(7), "k", 1024), 1024).first().n_unique == 7
    half = df.filter("k < 10000")
    assert abs(sketch.minimum_values_jaccard(least, sketch.minimum_values(half, "k", 1024), 1024).first()[0] - 0.5) < 0.1
    assert abs(sketch.theta_similarity(df, half, "k").first().jaccard - 0.5) < 0.05
    assert tuple(sketch.exact_similarity(df, half).first()) == (20_000, 10_000, 0.5)
    for n in sketch.distinct_sketches(df, "k").first():
        assert abs(n / 20_000 - 1) < 0.15


def test_distinct_sketches_are_within_a_tenth(spark, tmp_path):
    from skein.plans import registry

    for k in (13, 152, 194):  # where a standard error of 0.05 is off by more
        spark.range(k * 20_000, (k + 1) * 20_000).withColumnRenamed("id", "l_partkey").write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        assert tuple(registry.QUERIES["approx_distinct"](spark, f"{tmp_path}/{k}").first()) == (20_000, True, True, True)


def test_fingerprint_sets(spark):
    known = sketch.fingerprints(spark.range(1000).withColumnRenamed("id", "k"), "k", 16)
    probe = spark.range(500, 5000).withColumnRenamed("id", "k")
    members = {r.k for r in sketch.fingerprint_members(known, probe, "k", 16).collect()}
    assert set(range(500, 1000)) <= members and len(members) < 500 + 3 * 4000 * (1 - math.exp(-1000 / 65536))
    assert sketch.fingerprint_remove(known, spark.range(1000).withColumnRenamed("id", "k"), "k", 16).count() == 0


def test_bits(spark):
    numbers = [1, 2, 3, 4, 5, 1023, 1024, 2**40 + 1, 2**62]
    df = column(spark, [*numbers, 0, -1], "long").select(
        "k", bits.lg_floor(F.col("k")).alias("f"), bits.lg_ceil(F.col("k")).alias("c"), bits.floor_pow2(F.col("k")).alias("fp"), bits.ceil_pow2(F.col("k")).alias("cp"), bits.rotate_left(F.col("k"), 3).alias("l"),
        bits.rotate_right(bits.rotate_left(F.col("k"), 3), 3).alias("same"), bits.reverse_bits(F.col("k")).alias("r"), bits.reverse_bits(F.col("k"), 8).alias("r8"), bits.is_pow2(F.col("k")).alias("p"),
    )
    signed = lambda x: x - 2**64 if x >> 63 else x
    for r in df.collect():
        raw = r.k % 2**64
        assert r.same == r.k and r.l == signed((raw << 3 | raw >> 61) % 2**64)
        assert r.r == signed(int(f"{raw:064b}"[::-1], 2)) and r.r8 == int(f"{raw % 256:08b}"[::-1], 2)
        if r.k > 0:
            assert (r.f, r.c) == (r.k.bit_length() - 1, (r.k - 1).bit_length()) and (r.fp, r.cp) == (1 << r.f, 1 << r.c) and r.p == (r.fp == r.k)
        else:
            assert r.f is None and not r.p and (r.fp, r.cp) == (0, 1)


# ---- streams


def stream_of(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([("ab"[k % 2], k, float(k)) for k in range(20)], "s string, t long, x double").withColumn("t", F.timestamp_seconds("t"))
    stream = stream_of(spark, data, f"{tmp_path}/in")
    found = running.run_available(running.running_counts(stream, "s"), f"{tmp_path}/c1", "complete")
    assert rows(found) == [("a", 10), ("b", 10)]
    moved = running.run_available(running.moving_stats(stream, "s", "t", "x", 3), f"{tmp_path}/c2")
    last = moved.filter("s = 'a'").orderBy(F.col("t").desc()).first()
    assert (last.n, last["mean"], last.median) == (3, 16.0, 16.0) and moved.count() == 20
    decayed = running.run_available(running.decayed_counts(stream, "s", "t", 0.5), f"{tmp_path}/c3", "update")
    assert all(math.isclose(r.weight, sum(0.5**k for k in range(10))) and r.n == 10 for r in decayed.collect())
    windows = running.run_available(running.windowed_counts(stream, "s", "t", "10 seconds", "0 seconds"), f"{tmp_path}/c4", "update")
    assert windows.groupBy("s").sum("cnt").count() == 2


def test_every_row_gets_its_prefix_sums(spark, tmp_path):
    from skein.plans import registry

    arrays = [(k, [float(k + j) for j in range(k % 7)]) for k in range(120)]
    spark.createDataFrame(arrays, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.vec_id: r.cumsum for r in registry.QUERIES["array_cumsum"](spark, str(tmp_path)).collect()}
    assert found == {k: [sum(a[: j + 1]) for j in range(len(a))] for k, a in arrays}

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.functions.special import correlation_p_value, incomplete_beta
from locusloom.operators import scan
from locusloom.operators import stats as st
from locusloom.operators import values as vl
from locusloom.operators.qnorm import nonzero_qnorm, preprocess_qnorm, simple_qnorm


def matrix(spark, by_sample):
    cells = [("c", f"s{i}", j, float(v)) for i, row in enumerate(by_sample) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "chrom string, sample string, pos bigint, value double")


def as_matrix(df, n_samples, n_pos):
    out = np.zeros((n_samples, n_pos))
    for r in df.collect():
        out[int(r["sample"][1:]), r["pos"]] = r["value"]
    return out


# features x samples in the literature, samples x features here
WIKI = np.array([[5, 4, 3], [2, 1, 4], [3, 4, 6], [4, 2, 8]]).T
WIKI_OUT = np.array([[5.667, 4.667, 2], [2, 2, 3], [3, 4.667, 4.667], [4.667, 3, 5.667]]).T
ARRAY = np.array([[2, 4, 4, 5], [5, 14, 4, 7], [4, 8, 6, 9], [3, 8, 5, 8], [3, 9, 3, 5]]).T
ARRAY_OUT = np.array([[3.5, 3.5, 5, 3.5], [8.5, 8.5, 5, 5.5], [6.5, 5, 8.5, 8.5], [5, 5, 6.5, 6.5], [5, 6.5, 3.5, 3.5]]).T


@pytest.mark.parametrize(
    "given, want",
    [
        (WIKI, WIKI_OUT),
        (ARRAY, ARRAY_OUT),
        (np.array([[1, 2, 0, 3, 4], [5, 5, 0, 5, 9]]), np.array([[3, 3.5, 0, 4, 6.5], [3, 3, 0, 3, 6.5]])),
    ],
)
def test_nonzero_qnorm_goldens(spark, given, want):
    got = as_matrix(nonzero_qnorm(matrix(spark, given)), *given.shape)
    np.testing.assert_allclose(got, want, rtol=1e-3)


def test_weighted_rows_equal_spelled_out_positions(spark):
    rng = np.random.default_rng(3)
    wide = np.round(rng.integers(0, 5, (3, 8)) * rng.random((3, 8)), 3)
    width = rng.integers(1, 5, 8)
    long = np.repeat(wide, width, axis=1)
    cells = [("c", f"s{i}", j, float(wide[i, j]), int(width[j])) for i in range(3) for j in range(8)]
    df = spark.createDataFrame(cells, "chrom string, sample string, pos bigint, value double, w bigint")
    got = as_matrix(nonzero_qnorm(df), 3, 8)
    want = as_matrix(nonzero_qnorm(matrix(spark, long)), 3, long.shape[1])
    np.testing.assert_allclose(np.repeat(got, width, axis=1), want)


def test_preprocess_qnorm_goldens(spark):
    """Examples of the normalisation with average ranks, samples in columns."""
    wiki = np.array([[5, 4, 3], [2, 1, 4], [3, 4, 6], [4, 2, 8]], dtype=float).T
    want = np.array([[5.666667, 5.166667, 2], [2, 2, 3], [3, 5.166667, 4.666667], [4.666667, 3, 5.666667]]).T
    assert np.allclose(as_matrix(preprocess_qnorm(matrix(spark, wiki)), *wiki.shape), want, rtol=1e-6)
    other = np.array([[2, 4, 4, 5], [5, 14, 4, 7], [4, 8, 6, 9], [3, 8, 5, 8], [3, 9, 3, 5]], dtype=float).T
    want = np.array([[3.5, 3.5, 5.25, 4.25], [8.5, 8.5, 5.25, 5.5], [6.5, 5.25, 8.5, 8.5], [5.25, 5.25, 6.5, 6.5], [5.25, 6.5, 3.5, 4.25]]).T
    assert np.allclose(as_matrix(preprocess_qnorm(matrix(spark, other)), *other.shape), want, rtol=1e-6)


def test_simple_qnorm_wiki(spark):
    # the tie of the second sample is broken by position
    got = as_matrix(simple_qnorm(matrix(spark, WIKI)), *WIKI.shape)
    assert sorted(got[1]) == pytest.approx([2, 3, 14 / 3, 17 / 3])


@pytest.mark.parametrize("weighted", [False, True])
def test_percentiles_equal_numpy(spark, weighted):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.choice([0.0, -1.5, 1e-9, 3e12, rng.gauss(0, 100)]), rng.randrange(1, 5)) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, v double, w int")
    fractions = [0, 0.1, 0.5, 0.905, 0.9995, 1]
    got = {r["k"]: r["pct"] for r in vl.exact_percentiles(df, ["k"], F.col("v"), fractions, F.col("w") if weighted else None).collect()}
    for k in "ab":
        values = [v for kk, v, w in data if kk == k for _ in range(w if weighted else 1)]
        np.testing.assert_allclose(got[k], np.percentile(values, [f * 100 for f in fractions]), rtol=1e-9, atol=1e-9)


def test_decile_ranks(spark, rows):
    df = spark.createDataFrame([("c", float(i)) for i in range(0, 11)], "chrom string, v double")
    got = rows(vl.decile_ranks(df, ["chrom"], "v"), "v", "dec_rank")
    edges = np.percentile(np.arange(1, 11), np.arange(10, 101, 10))
    assert got == [(float(i), 0 if i == 0 else 1 + int((edges < i).sum())) for i in range(11)]


def test_flat_signal_gets_the_lowest_rank(spark, rows):
    df = spark.createDataFrame([("c", 2.0)] * 4 + [("c", 0.0)], "chrom string, v double")
    assert set(rows(vl.decile_ranks(df, ["chrom"], "v"), "dec_rank")) == {(0,), (1,)}


def test_downsampling_is_seeded_and_balanced(spark):
    df = spark.createDataFrame([(i % 3 == 0, f"n{i}") for i in range(300)], "y boolean, name string")
    one, two = (vl.sample_per_class(df, "y", "name", 50, seed=1).collect() for _ in range(2))
    assert sorted(one) == sorted(two)
    assert [sum(r["y"] == c for r in one) for c in (True, False)] == [50, 50]
    assert vl.sample_per_class(df, "y", "name", 500).count() == 200


def brute_tau(a, b):
    p = q = ta = tb = 0
    for i in range(len(a)):
        for j in range(i):
            x, y = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
            p, q = p + (x * y > 0), q + (x * y < 0)
            ta, tb = ta + (x != 0), tb + (y != 0)
    return (p - q) / np.sqrt(ta) / np.sqrt(tb)


def test_kendall_tau_equals_pair_count(spark):
    rng = random.Random(9)
    data = [(k, rng.randrange(12), rng.random() if k == "u" else rng.randrange(5) * 1.0) for k in "uv" for _ in range(120)]
    df = spark.createDataFrame(data, "k string, a int, b double")
    for r in st.kendall_tau(df, ["k"], "a", "b").collect():
        a, b = zip(*[(x, y) for k, x, y in data if k == r["k"]])
        assert r["stat"] == pytest.approx(brute_tau(a, b))


def test_spearman_and_auc(spark):
    rng = random.Random(11)
    data = [(rng.randrange(2), rng.randrange(9) / 4) for _ in range(200)]
    df = spark.createDataFrame(data, "y int, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert st.roc_auc(df, "y", "s").first()["score"] == pytest.approx(want)
    same = spark.createDataFrame([("k", float(i), float(i**3)) for i in range(20)], "k string, a double, b double")
    assert st.weighted_spearman(same, ["k"], "a", "b").first()["stat"] == pytest.approx(1.0)


def test_p_values(spark):
    # I_x(a, b) at known points, and the t distribution with 8 degrees of freedom at r = 0.6319 (5 %)
    assert incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)
    assert incomplete_beta(2, 2, 0.5) == pytest.approx(0.5)
    df = spark.createDataFrame([(0.6319, 10), (0.0, 10)], "r double, n int")
    got = [x[0] for x in df.select(correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-4) and got[1] == pytest.approx(1.0)


def test_unknown_scorer_is_an_error(spark):
    from locusloom.operators.modeling import score_table

    with pytest.raises(ValueError, match="unknown scorer"):
        score_table(spark.createDataFrame([(1, 1)], "y int, prediction int"), "nonsense", "y")


def test_correlation_of_large_values_that_vary_little(spark):
    df = spark.createDataFrame([("k", 1e9 + i, 1e9 - i + (i % 3)) for i in range(60)], "k string, a double, b double")
    got = st.weighted_pearson(df, ["k"], "a", "b").first()["stat"]
    want = df.agg(F.corr("a", "b")).first()[0]
    assert got == pytest.approx(want, abs=1e-9)
    assert st.weighted_pearson(df, [], "a", "b").first()["stat"] == pytest.approx(want, abs=1e-9)
    total = sum((i - 29.5) ** 2 for i in range(60))
    off = sum((2 * i - i % 3) ** 2 for i in range(60))
    assert st.r2(df, "a", "b").first()["score"] == pytest.approx(1 - off / total, rel=1e-9)


def test_ranks_leave_null_out_and_put_nan_last(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("k", x) for x in (1.0, nan, None, inf, -inf, 2.0, None)], "k string, x double")
    ranks = {str(r["x"]): r["min_rank"] for r in vl.rank_values(df, ["k"], "x").collect()}
    assert ranks == {"-inf": 1, "1.0": 2, "2.0": 3, "inf": 4, "nan": 5}


def test_value_axis_follows_the_data(spark):
    """A million values in [0.9999, 1) spread evenly over tiles, beside a few far away."""
    df = spark.range(1_000_000).select((F.lit(0.9999) + F.col("id") * 1e-10).alias("v")).unionByName(spark.range(100).select((F.col("id") * 1e6 - 5e7).alias("v")))
    tiles = scan.with_axis(df, "v").groupBy(F.col("_axis").alias("t")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    found = tiles.orderBy("t").collect()
    assert max(r.n for r in found) < 3_000
    assert all(a.hi < b.lo for a, b in zip(found, found[1:], strict=False))


def test_value_axis_of_odd_values(spark):
    values = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0, 2.5, -3.0, 1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.n_below for r in vl.rank_values(df, [], "v").orderBy("n_below").collect()]
    assert got == [0, 1, 2, 3, 5, 6, 8, 9, 10, 11]
    none = spark.createDataFrame([(None,)], "v double")
    assert vl.rank_values(none, [], "v").collect() == [] and vl.exact_percentiles(none, [], F.col("v"), [0.5]).collect() == []


def test_tile_totals_are_scanned_in_blocks(spark, rows):
    """Over 2^32 line numbers without a key no window task holds more than a block of tile totals."""
    df = spark.range(6_000).select((F.col("id") * 1_000_003).alias("at"), (F.col("id") % 7).alias("v"))
    out = scan.prefix_scan(df, [], "at", scan.position_tile(F.col("at")), {"s": ("sum", F.col("v")), "m": ("max", F.col("at"))}, blocks=True)
    total, want = 0, []
    for i in range(6_000):
        want.append((i * 1_000_003, total, (i - 1) * 1_000_003 if i else None))
        total += i % 7
    assert sorted((r["at"], r.s, r.m) for r in out.collect()) == want
    tiles = df.select(F.shiftright(scan.position_tile(F.col("at")), scan.BLOCK_BITS).alias("b"), scan.position_tile(F.col("at")).alias("t")).distinct()
    assert tiles.groupBy("b").count().agg(F.max("count")).first()[0] <= 1 << scan.BLOCK_BITS
    assert tiles.select("b").distinct().count() == 6  # what the last window sees


def test_bottom_k_equals_sorting(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 19_000, "big").otherwise("small").alias("y"), F.concat(F.lit("n"), F.col("id") % 15_000).alias("name"))
    digest = F.md5("name")
    got = sorted((r.y, r.name) for r in vl.bottom_k(df, ["y"], digest, [F.col("name")], 300).collect())
    import hashlib

    want = []
    for y, ids in (("big", range(19_000)), ("small", range(19_000, 20_000))):
        names = sorted((f"n{i % 15_000}" for i in ids), key=lambda n: (hashlib.md5(n.encode()).hexdigest(), n))
        want += [(y, n) for n in names[:300]]
    assert got == sorted(want)


def test_bottom_k_deals_out_no_row_of_a_later_bucket(spark):
    """Rows meet the last buckets by broadcast, so no class is dealt out whole, whatever the optimiser would do."""
    df = spark.range(20_000).select((F.col("id") % 3).alias("y"), F.col("id").cast("string").alias("name"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = vl.sample_per_class(df, "y", "name", 50, seed=1)
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        n = chosen.groupBy("y").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r["y"], r["count"]) for r in n) == [(0, 50), (1, 50), (2, 50)]


def test_pairs_are_summed_up_from_tracks_summed_up_once(spark):
    """The same as of all pairs' segments; pairs are made of the tracks' totals, not of every segment."""
    rng = random.Random(31)
    cuts = [sorted(rng.sample(range(300), 24)) for _ in range(3)]
    schema = "chrom string, start bigint, end bigint, value double"
    tracks = {f"t{i}": spark.createDataFrame([(c, s, e, rng.gauss(1, 2)) for c in "xy" for s, e in zip(at[::2], at[1::2])], schema) for i, at in enumerate(cuts)}
    blocks = spark.createDataFrame([(c, s, s + rng.randint(3, 9)) for c in "xy" for s in range(0, 300, 12)], "chrom string, start bigint, end bigint")
    got = st.pair_summary(tracks, blocks, skip_size=4)
    want = st.segment_summary(st.segment_pairs(tracks, blocks, skip_size=4), [*st.PAIR, "chrom"])
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan and "sample_a" not in plan[plan.index("Aggregate [") :]

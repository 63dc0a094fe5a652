import random
import re

import pytest
from pyspark.sql import functions as F

from locusloom.operators import dominance
from locusloom.operators import intervals as iv
from locusloom.operators import overlap as ov
from locusloom.operators.scan import prefix_scan

REGION = "chrom string, start bigint, end bigint"


def random_regions(seed, n=300, span=3000, longest=200, chroms=("chr1", "chr2")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(span)
        out.append((rng.choice(chroms), s, s + rng.randrange(1, longest), f"r{i}"))
    # copies of one region, and one region over everything
    out += [("chr1", 50, 90, f"c{i}") for i in range(100)] + [("chr2", 0, span + longest, "all")]
    return out


def brute_islands(regions):
    out = []
    for c in sorted({r[0] for r in regions}):
        cur = None
        for s, e in sorted((r[1], r[2]) for r in regions if r[0] == c):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
                cur[2] += 1
            else:
                if cur:
                    out.append((c, *cur))
                cur = [s, e, 1]
        out.append((c, *cur))
    return sorted(out)


@pytest.mark.parametrize("bits", [3, 6, 20])
@pytest.mark.parametrize("longest", [8, 200])
def test_merge_equals_sweep(spark, rows, bits, longest):
    data = [r for r in random_regions(1, longest=longest) if r[3] != "all"]
    df = spark.createDataFrame(data, REGION + ", name string")
    assert rows(iv.merge_overlapping(df, bits=bits), "chrom", "start", "end", "n_merged") == brute_islands(data)


def test_book_ended_regions_merge_and_last_island_stays(spark, rows):
    df = spark.createDataFrame([("c", 0, 5), ("c", 5, 9), ("c", 10, 12)], REGION)
    assert rows(iv.merge_overlapping(df), "start", "end", "n_merged") == [(0, 9, 2), (10, 12, 1)]


def test_merge_with_names(spark, rows):
    df = spark.createDataFrame([("c", 4, 9, "b"), ("c", 0, 5, "a"), ("c", 20, 22, "x")], REGION + ", name string")
    assert rows(iv.merge_with_names(df), "start", "end", "name") == [(0, 9, "a-b"), (20, 22, "x")]
    with pytest.raises(Exception, match="too many members"):
        iv.merge_with_names(df, max_names=1).collect()


@pytest.mark.parametrize("mode", ["overlap", "contained"])
def test_range_join_equals_nested_loop(spark, rows, mode):
    a, b = random_regions(2), random_regions(3, n=200, longest=2500)
    da, db = (spark.createDataFrame(x, REGION + ", name string") for x in (a, b))
    hit = (lambda x, y: x[1] < y[2] and x[2] > y[1]) if mode == "overlap" else (lambda x, y: y[1] >= x[1] and y[2] <= x[2])
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and hit(x, y))
    assert rows(iv.range_join(da, db, mode=mode), "name", "name_r") == want


@pytest.mark.parametrize("longest", [5, 3_000, 40_000, 3_000_000])
def test_range_join_of_long_and_short(spark, rows, longest):
    """Intervals over several levels of the tree, from one position to a thousand leaves and more."""
    rng = random.Random(longest)
    a = [("c", s, s + rng.choice([1, 3, rng.randint(1, longest)]), f"a{i}") for i in range(150) for s in [rng.choice([0, 1023, 1024, rng.randrange(3_000_000)])]]
    b = [("c", s, s + rng.choice([1, 1024, rng.randint(1, longest)]), f"b{i}") for i in range(150) for s in [rng.choice([1024, 16384, rng.randrange(3_000_000)])]]
    da, db = (spark.createDataFrame(x, REGION + ", name string") for x in (a, b))
    for mode, hit in (("overlap", lambda x, y: x[1] < y[2] and x[2] > y[1]), ("contained", lambda x, y: y[1] >= x[1] and y[2] <= x[2])):
        want = sorted((x[3], y[3]) for x in a for y in b if hit(x, y))
        assert rows(iv.range_join(da, db, mode=mode), "name", "name_r") == want


def test_short_intervals_beside_a_long_one_spread(spark):
    """100,000 short intervals and one as long as the chromosome: no cell holds above 2 % of the rows."""
    n, span = 100_000, 250_000_000
    short = spark.range(n).select(F.lit("c").alias("chrom"), F.pmod(F.xxhash64("id"), F.lit(span)).alias("start")).withColumn("end", F.col("start") + 50)
    long = spark.createDataFrame([("c", 0, span + 100)], REGION)
    _, fits = iv._levels(short, ["chrom"])
    longest, _ = iv._levels(long, ["chrom"])
    top = F.least(longest, fits)
    points = iv._point_cells(short, F.col("start"), top)
    cells = iv._interval_cells(long, F.col("start"), F.col("end"), top)
    met = points.join(cells.select("_level", "_cell"), ["_level", "_cell"]).groupBy("_level", "_cell").count()
    assert met.agg(F.sum("count")).first()[0] == n
    assert met.agg(F.max("count")).first()[0] <= n // 50
    assert cells.count() < 5_000
    assert iv.range_join(long, short).count() == iv.range_join(short, long).count() == n


@pytest.mark.parametrize("bits", [4, 20])
def test_overlap_totals_equal_nested_loop(spark, rows, bits):
    a, b = random_regions(4), random_regions(5, longest=900)
    da, db = (spark.createDataFrame(x, REGION + ", name string") for x in (a, b))
    want = []
    for x in a:
        shared = [min(x[2], y[2]) - max(x[1], y[1]) for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1]]
        want.append((x[3], len(shared), sum(shared)))
    assert rows(iv.overlap_totals(da, db, bits), "name", "n_overlap", "bp_overlap") == sorted(want)


def test_containment_flags(spark, rows):
    a, b = random_regions(6, longest=400), random_regions(7, longest=60)
    da, db = (spark.createDataFrame(x, REGION + ", name string") for x in (a, b))
    inside = sorted((y[3], any(x[0] == y[0] and x[1] <= y[1] and x[2] >= y[2] for x in a)) for y in b)
    contains = sorted((x[3], any(x[0] == y[0] and x[1] <= y[1] and x[2] >= y[2] for y in b)) for x in a)
    assert rows(iv.inside_any(db, da), "name", "inside") == inside
    assert rows(iv.contains_any(da, db), "name", "contains") == contains


def test_gaps_runs_and_disjointness(spark, rows):
    df = spark.createDataFrame([("c", 2, 4), ("c", 4, 6), ("c", 9, 30)], REGION)
    sizes = spark.createDataFrame([("c", 20), ("d", 7)], "chrom string, size bigint")
    assert rows(iv.gaps(df, sizes), "chrom", "start", "end") == [("c", 0, 2), ("c", 6, 9), ("d", 0, 7)]
    assert rows(iv.gaps(df, sizes, 1), "chrom", "start", "end") == [("c", 1, 2), ("c", 6, 9), ("d", 1, 7)]
    assert iv.overlapping_rows(df).isEmpty()
    assert not iv.overlapping_rows(df.union(df)).isEmpty()


def test_malformed_region_fails(spark):
    df = spark.createDataFrame([("c", 5, 5)], REGION)
    with pytest.raises(Exception, match="malformed region"):
        iv.check_regions(df).collect()


def test_three_sets_give_each_pair_once(spark):
    df = spark.createDataFrame([("c", 0, 10, "x"), ("c", 20, 30, "y")], REGION + ", name string")
    out = ov.pairwise_overlap({"A": df, "B": df, "C": df}).filter("chrom = 'wg'").collect()
    assert sorted((r["label_a"], r["label_b"], r["jaccard"]) for r in out) == [("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0)]


def test_set_absent_on_a_chromosome(spark):
    a = spark.createDataFrame([("c", 0, 10, "x")], REGION + ", name string")
    b = spark.createDataFrame([("d", 0, 10, "y")], REGION + ", name string")
    got = {r["chrom"]: r for r in ov.pairwise_overlap({"A": a, "B": b}).collect()}
    assert got["c"]["a_miss"] == 1 and got["d"]["b_miss"] == 1 and got["wg"]["ovl_cov_bp"] == 0


# ---------------------------------------------------------------- one sweep over all sets


def brute_pairs(sets, mode, rois=None):
    """Counts of each pair of sets per chromosome, by nested loops."""
    inside = lambda o, x: o[0] == x[0] and o[1] <= x[1] and x[2] <= o[2]
    shared = lambda x, y: min(x[2], y[2]) - max(x[1], y[1]) if x[0] == y[0] else 0
    strictly = lambda o, x: o[0] == x[0] and o[1] < x[1] and x[2] <= o[2]
    cut = sets if rois is None else [sorted({x for x in d if any(strictly(o, x) for o in rois)}) for d in sets]
    out = {}
    for i, j in [(i, j) for j in range(len(sets)) for i in range(j)]:
        for chrom in {x[0] for d in (*cut, rois or []) for x in d}:
            a, b = ([x for x in cut[k] if x[0] == chrom] for k in (i, j))
            if mode == "contained":
                a_hits = {x[3] for x in a if any(inside(x, y) for y in b)}
                b_hits = {y[3] for y in b if any(inside(x, y) for x in a)}
                bp = sum(y[2] - y[1] for x in a for y in b if inside(x, y))
            else:
                a_hits = {x[3] for x in a if any(shared(x, y) > 0 for y in b)}
                b_hits = {y[3] for y in b if any(shared(x, y) > 0 for x in a)}
                bp = sum(max(0, shared(x, y)) for x in a for y in b)
            own = [o for o in rois or [] if o[0] == chrom]
            held = sum(any(strictly(o, x) for d in (sets[i], sets[j]) for x in d) for o in own)
            cov = [sum(x[2] - x[1] for x in d) for d in (a, b)]
            counts = (len(a), cov[0], len(a_hits), len(b), cov[1], len(b_hits), bp, held, len(own) - held)
            if any(counts):
                out[i, j, chrom] = counts
    return out


@pytest.mark.parametrize("mode", ["contained", "overlap"])
@pytest.mark.parametrize("with_rois", [False, True])
def test_all_pairs_of_sets_equal_nested_loops(spark, mode, with_rois):
    data = [random_regions(11, n=120, longest=300), random_regions(12, n=90, longest=60), random_regions(13, n=60, longest=900, chroms=("chr1", "chr3"))]
    data[1] += data[0][:20]  # shared intervals and names
    roi_rows = [(c, s - 1, e + 40) for c, s, e, _ in random_regions(14, n=25, longest=400) if s > 0]
    sets = [spark.createDataFrame(d, REGION + ", name string") for d in data]
    rois = spark.createDataFrame(roi_rows, REGION) if with_rois else None
    lines = ov.pair_counts(sets, rois, mode)
    got = {(r[0], r[1], r["chrom"]): tuple(r)[3:] for r in lines.groupBy("_a", "_b", "chrom").agg(*[F.sum(c).alias(c) for c in ov._COUNTS]).collect()}
    assert {k: v for k, v in got.items() if any(v)} == brute_pairs(data, mode, roi_rows if with_rois else None)


def test_nested_intervals_stay_linear(spark):
    """20,000 nested intervals hold 2 * 10^8 pairs; what is shuffled is about twenty rows for each."""
    n = 20_000
    nested = spark.range(n).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (2 * n - F.col("id")).alias("end"))
    points = dominance.nested_points(nested, ["chrom"], {"o": F.lit(1)}, {"i": F.col("end") - F.col("start")})
    assert points.count() < 20 * n
    got = dominance.nested_sums(nested, ["chrom"], {"o": F.lit(1)}, {"i": F.col("end") - F.col("start")}, [("o", "i")]).agg(F.sum("o_i")).first()[0]
    assert got == sum((i + 1) * (2 * n - 2 * i) for i in range(n))


@pytest.mark.parametrize("mode", ["contained", "overlap"])
def test_number_of_shuffles_does_not_grow_with_the_sets(spark, mode):
    df = spark.createDataFrame(random_regions(15, n=20), REGION + ", name string")

    def shuffles(n):
        plan = ov.pairwise_overlap({f"s{i}": df for i in range(n)}, mode=mode)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert shuffles(2) == shuffles(5) <= 18  # some are one shuffle read twice


def test_gaps_deal_out_nothing_by_chromosome_alone(spark, rows):
    """No join on the chromosome, whose rows would meet in one task; chromosomes without a size give no gap."""
    data = random_regions(16, n=60)
    df = spark.createDataFrame(data, REGION + ", name string")
    chroms = sorted({r[0] for r in data})
    sizes = spark.createDataFrame([(c, 3_000 + i) for i, c in enumerate(chroms[1:])] + [("empty", 5)], "chrom string, size bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        free = iv.gaps(df, sizes)
        plan = free._jdf.queryExecution().executedPlan().toString()
        got = rows(free, "chrom", "start", "end")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"Join \[chrom#\d+L?\], ", plan)
    want = []
    for c, size in [(r["chrom"], r["size"]) for r in sizes.collect()]:
        at = 0
        for s, e in sorted((s, e) for x, s, e, _ in data if x == c) + [(size, size)]:
            if min(s, size) > at:
                want.append((c, at, min(s, size)))
            at = max(at, e)
    assert got == sorted(want)


def counted(spark, rows, schema):
    """Rows as a table, with a counter of how often they are read."""
    seen = spark.sparkContext.accumulator(0)

    def told(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(told), schema), seen


def test_scan_reads_its_rows_once(spark):
    df, seen = counted(spark, [("a", i, i % 3, "x") for i in range(40)], "chrom string not null, pos long, v long, other string")
    got = prefix_scan(df, ["chrom"], "pos", F.shiftright("pos", 3), {"s": ("sum", F.col("v"))}).collect()
    assert {r.pos: r.s for r in got} == {i: sum(j % 3 for j in range(i)) for i in range(40)}
    assert seen.value == 40


def test_range_join_folds_its_left_rows_once(spark):
    """Extents and starts of the left rows come from one pass: two would fold them twice, in one task each time."""
    data = random_regions(26, n=30)
    left, right = spark.createDataFrame(data, REGION + ", name string"), spark.createDataFrame(data[::2], REGION + ", name string")
    joined = iv.range_join(left.select("chrom", "start", "end").distinct(), right, left_bound=left)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[chrom#\d+, start#\d+L, end#\d+L\]", plan)) == 1
    got = sorted((r.chrom, r.start, r.end, r.name_r) for r in joined.collect())
    spans = {r[:3] for r in data}
    assert got == sorted((c, s, e, n) for c, s, e in spans for d, t, f, n in data[::2] if c == d and s < f and t < e)


def test_range_join_folds_its_right_rows_once_and_broadcasts_no_cells(spark):
    data = random_regions(27, n=30)
    left, right = spark.createDataFrame(data, REGION + ", name string"), spark.createDataFrame(data[::2], REGION + ", name string")
    joined = iv.range_join(left, right.groupBy("chrom", "start", "end").agg(F.count("name").alias("n")), right_bound=right)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[chrom#\d+, start#\d+L, end#\d+L\]", plan)) == 1
    assert not re.search(r"BroadcastHashJoin.*_cell", joined._jdf.queryExecution().executedPlan().toString())
    got = sorted((r.chrom, r.start, r.end, r.name, r.start_r, r.end_r) for r in joined.collect())
    others = {r[:3] for r in data[::2]}
    assert got == sorted((c, s, e, n, t, f) for c, s, e, n in data for d, t, f in others if c == d and s < f and t < e)


def test_islands_read_their_rows_once(spark):
    """Rows and tiles read one shuffle, though rows without a chromosome are left out; islands aren't folded before they are joined."""
    data = [r for r in random_regions(24, n=30) if r[3] != "all"]
    df, seen = counted(spark, [*data, (None, 1, 2, "x")], REGION + ", name string")
    merged = iv.merge_overlapping(df, bits=4, total=F.col("end") - F.col("start"))
    got = sorted((r.chrom, r.start, r.end, r.n_merged) for r in merged.collect())
    assert got == brute_islands(data)
    assert seen.value == len(data) + 1
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 4  # equal starts (for rows and tiles), tiles, islands


def test_members_read_their_rows_twice(spark):
    """Once for the islands, once to be given theirs; starts aren't looked up in islands built apart."""
    data = [r for r in random_regions(25, n=30) if r[3] != "all"]
    df, seen = counted(spark, data, REGION + ", name string")
    got = iv.island_members(df).collect()
    islands = brute_islands(data)
    assert sorted((r.chrom, r.start, r.end, r.name) for r in got) == sorted(data)
    assert all((r.chrom, r.island_start, r.island_end) in {i[:3] for i in islands} and r.island_start <= r.start <= r.end <= r.island_end for r in got)
    assert seen.value == 2 * len(data)


def test_islands_are_built_once_for_their_names(spark):
    rows = random_regions(21, n=30)
    df, seen = counted(spark, rows, REGION + ", name string")
    assert sum(r.n_merged for r in iv.merge_with_names(df).collect()) == len(rows)
    assert seen.value <= 4 * len(rows)  # rows, their starts, and islands, which aren't built again to be counted


def test_restricted_rows_are_read_for_one_scan(spark):
    named = random_regions(22, n=30)
    df, seen = counted(spark, named, REGION + ", name string")
    rois = spark.createDataFrame([(c, s - 5, e + 5) for c, s, e, _ in named[:8]], REGION)
    other = spark.createDataFrame(named[10:], REGION + ", name string")
    got = {r.chrom: r for r in ov.pair_stats(df, other, rois).collect()}
    inside = {r for r in named if any(c == r[0] and r[1] > s - 5 and r[2] <= e + 5 for c, s, e, _ in named[:8])}
    assert sum(r.a_num for r in got.values()) == len(inside)
    held = lambda c, s, e: any(r[0] == c and r[1] > s - 5 and r[2] <= e + 5 for r in named)
    assert sum(r.roi_hits for r in got.values()) == sum(held(c, s, e) for c, s, e, _ in named[:8])
    assert seen.value == 2 * len(named)  # ends, rows


def test_overlap_looks_rows_up_once(spark):
    df = spark.createDataFrame(random_regions(23, n=20), REGION + ", name string")
    plan = ov.pairwise_overlap({"a": df, "b": df}, mode="overlap")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1

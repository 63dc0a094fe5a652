import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.functions import names as nm
from locusloom.functions import sequence as sq
from locusloom.operators import features as ft
from locusloom.operators import signal as sg
from locusloom.operators import tables as tb
from locusloom.operators.matching import greedy_pairs, match_background, nearest_within

SEQ = "ACGTNacgcgTATAAAAGGGCGGACGTTGNCAGTCAGT"


def one_sequence(spark, seq=SEQ):
    return spark.createDataFrame([("c", 0, len(seq), seq)], "chrom string, start bigint, end bigint, seq string")


def test_composition_features(spark):
    row = one_sequence(spark).select(*sq.sequence_columns(["len", "gc", "cpg", "oecpg", "rep"])).first()
    low, n = SEQ.lower(), len(SEQ)
    assert row["ftlen_abs_length"] == n
    assert row["ftgc_pct_GC"] == pytest.approx((low.count("g") + low.count("c")) / n * 100)
    assert row["ftcpg_pct_CpG"] == pytest.approx(low.count("cg") / (n / 2) * 100)
    assert row["ftoecpg_rat_oeCpG"] == pytest.approx(low.count("cg") / (low.count("g") * low.count("c")) * n)
    assert row["ftrep_pct_repcon"] == pytest.approx(sum(SEQ.count(c) for c in "acgt") / n * 100)


def test_relative_length_uses_the_yardstick(spark):
    row = one_sequence(spark).select(*sq.sequence_columns(["len"], 2 * len(SEQ))).first()
    assert row["ftlen_pct_length"] == pytest.approx(50)


def test_motifs_count_whole_matches(spark):
    row = one_sequence(spark).select(*sq.sequence_columns(["prm"])).first()
    for name, pattern in sq.CORE_PROMOTER_MOTIFS:
        found = [m.group(0) for m in re.finditer(pattern, SEQ.upper())]
        assert row[f"ftprm_abs_{name}"] == len(found)
        assert row[f"ftprm_pct_{name}"] == pytest.approx(sum(map(len, found)) / len(SEQ) * 100)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_kmers_across_pieces(spark, monkeypatch, k):
    monkeypatch.setattr(sq, "PIECE", 7)
    monkeypatch.setattr(sq, "SHORT_PIECE", 3)
    up = SEQ.upper()
    words = [up[i : i + k] for i in range(len(up) - k + 1)]
    got = {r["kmer"]: r["n"] for r in sq.kmer_counts(one_sequence(spark), ["chrom"], k).collect()}
    assert got == {w: words.count(w) for w in set(words)}
    wide = sq.kmer_table(one_sequence(spark), ["chrom"], k).first().asDict()
    assert len(wide) == 1 + 5**k and sum(v for c, v in wide.items() if c != "chrom") == pytest.approx(100)


def test_sequence_shorter_than_the_word(spark):
    wide = sq.kmer_table(one_sequence(spark, "A"), ["chrom"], 2).first().asDict()
    assert set(wide.values()) == {"c", 0.0}


def test_dnase_counts_each_window_once(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGTacgtN") for _ in range(120))
    up = seq.upper()
    probs = []
    for i in range(len(up) - 5):
        word = up[i : i + 6]
        if "N" not in word:
            probs.append(np.prod([sq.DNASE_HEXAMER[c][j] / 100 for j, c in enumerate(word)]))
    row = sq.dnase_motif(one_sequence(spark, seq), ["chrom"]).first()
    med = np.median(probs)
    assert row["ftdnm_abs_medprob"] == pytest.approx(med)
    assert row["ftdnm_abs_maxprob"] == pytest.approx(max(probs))
    assert row["ftdnm_abs_medad"] == pytest.approx(np.median(np.abs(np.array(probs) - med)))
    assert sq.dnase_motif(one_sequence(spark, "NNNNNNNN"), ["chrom"]).first()["ftdnm_abs_maxprob"] == 0


def test_windows(spark, rows):
    df = spark.createDataFrame([("c", 0, 10, "a"), ("c", 3, 5, "b"), ("c", 5, 12, "e")], "chrom string, start bigint, end bigint, name string")
    want = []
    for s, e, n in ((0, 10, "a"), (3, 5, "b"), (5, 12, "e")):
        inside = [(n, i, i + 4) for i in range(s, e // 4 * 4, 2) if i + 4 <= e]
        want += inside or [(n, s, e)]
    assert rows(ft.sliding_windows(df, 4, 2), "source", "start", "end") == sorted(want)
    with pytest.raises(ValueError):
        ft.sliding_windows(df, 2, 4)


def test_windows_of_documents_whose_ids_repeat(spark, tmp_path):
    from locusloom.plans.queries import QUERIES

    rng = random.Random(4)
    long = "".join(rng.choice("abcgtACGTZ ,\u00e9") for _ in range(9_000))
    documents = [(1, long), (1, long), (1, long[::-1][:700]), (2, "Zaz gc."), (None, "GCgc" * 60), (3, ""), (3, None), (4, "ZZ"), (5, "tt" * 2_048 + "cc" * 200)]
    table = spark.createDataFrame([(i, t, "en") for i, t in documents], "doc_id bigint, text string, lang string")
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    letters = str.maketrans("bdefhijklmnopqrsuvwxyzBDEFGHIJKLMOPQRSUVWXY", "acgtacgtacgtacgtacgtacACGTACGTACGTACGTACGTA", "Z")
    want = []
    for i, t in documents:
        seq = None if t is None else re.sub("[^A-Za-z]", "N", t).translate(letters)
        n = -1 if seq is None else len(seq)
        starts = [s for s in range(0, n // 200 * 200, 100) if s + 200 <= n]
        for s, e in [(s, s + 200) for s in starts] or [(0, n)] * (n >= 0):
            part = seq[s:e]
            gc, low = (f"{sum(c in k for c in part) / len(part) * 100:.4f}" if part else "nan" for k in ("GCgc", "acgt"))
            want.append(("doc" + ("" if i is None else str(i)), s, e, e - s, gc, low))
    got = [(*r[:4], f"{r[4]:.4f}", f"{r[5]:.4f}") for r in QUERIES["window_sequences"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len([w for w in want if w[0] == "doc1"]) > 160


def test_training_positions_are_seeded(spark):
    sizes = spark.createDataFrame([("c", 100_000), ("d", 50_000)], "chrom string, size bigint")
    one, two = (ft.training_positions(sizes, 7, 25, seed=3).collect() for _ in range(2))
    assert sorted(one) == sorted(two) and len(one) == 35
    assert all(r["end"] - r["start"] == 25 for r in one)


def test_roi_quantifiers(spark):
    regions = spark.createDataFrame([("c", 0, 10, "a"), ("c", 50, 60, "b")], "chrom string, start bigint, end bigint, name string")
    rois = spark.createDataFrame([("c", 5, 8), ("c", 6, 20)], "chrom string, start bigint, end bigint")
    got = {r["name"]: r for r in ft.roi_features(regions, rois, "x").collect()}
    assert (got["a"]["ftroi_x_bin_obs"], got["a"]["ftroi_x_abs_num"], got["a"]["ftroi_x_pct_cov"]) == (1, 2, 70.0)
    assert (got["b"]["ftroi_x_bin_obs"], got["b"]["ftroi_x_abs_num"], got["b"]["ftroi_x_pct_cov"]) == (0, 0, 0.0)
    assert ft.roi_features(regions, rois, "x", ["counts"]).columns[4:] == ["ftroi_x_abs_num"]


def dense(length, runs):
    out = np.zeros(length)
    for s, e, v in runs:
        out[s:e] = v
    return out


def test_masked_stats_equal_masked_array(spark):
    rng = random.Random(8)
    cuts = sorted(rng.sample(range(400), 40))
    runs = [(s, e, round(rng.gauss(2, 3), 2)) for s, e in zip(cuts[::2], cuts[1::2])]
    blocks = [(0, 30), (30, 55), (100, 180), (250, 251), (300, 390)]
    regions = [(0, 400), (10, 60), (60, 90), (120, 320), (250, 252), (250, 252)]
    sig, cons = dense(400, runs), np.zeros(400, bool)
    for s, e in blocks:
        cons[s:e] = True
    frame = lambda data, cols: spark.createDataFrame([("c", *d) for d in data], "chrom string, start bigint, end bigint" + cols)
    for long_region in (1 << 20, 45):
        sg.LONG_REGION, kept = long_region, sg.LONG_REGION
        try:
            got = {(r["start"], r["end"]): r for r in sg.masked_stats(frame(regions, ""), frame(runs, ", value double"), frame(blocks, ""), "x").collect()}
        finally:
            sg.LONG_REGION = kept
        for s, e in set(regions):
            values = sig[s:e][cons[s:e]]
            r = got[s, e]
            assert r["ftmsig_x_pct_cons"] == pytest.approx(len(values) / (e - s) * 100)
            stats = (values.mean(), np.median(values), values.max(), values.min()) if len(values) else (0, 0, 0, 0)
            assert [r[f"ftmsig_x_abs_{m}"] for m in ("mean", "median", "max", "min")] == pytest.approx(stats)


def test_overlay_takes_the_last_line(spark):
    lines = [("c", 0, 10, 1.0, 0), ("c", 5, 8, 2.0, 1), ("c", 6, 20, 3.0, 2), ("c", 30, 31, 4.0, 3)]
    df = spark.createDataFrame(lines, "chrom string, start bigint, end bigint, value double, n bigint")
    got = dense(40, [(r["start"], r["end"], r["value"]) for r in sg.overlay_last_wins(df, "n").collect()])
    assert (got == dense(40, [x[1:4] for x in lines])).all()


@pytest.mark.parametrize("stat", ["mean", "max", "min", "sum", "median", "product"])
def test_bins_equal_numpy(spark, stat):
    runs = [(2, 9, 1.5), (9, 13, -2.0), (15, 16, 4.0), (20, 25, 3.0)]
    df = spark.createDataFrame([("c", *r) for r in runs], "chrom string, start bigint, end bigint, value double")
    sizes = spark.createDataFrame([("c", 28)], "chrom string, size bigint")
    sig = dense(28, runs)
    fold = {"product": np.prod}.get(stat) or getattr(np, stat)
    got = {r["start"]: (r["end"], r["value"]) for r in sg.bin_signal(df, sizes, 5, stat, 2).collect()}
    for lo in range(2, 26, 5):
        hi = min(lo + 5, 26)
        if (sig[lo:hi] != 0).any():
            assert got[lo] == (hi, pytest.approx(fold(sig[lo:hi])))


def test_lift_over_reverses_minus_blocks(spark):
    runs = [(0, 4, 1.0), (5, 9, 2.0), (12, 30, 3.0)]
    blocks = [(1, "c", 2, 8, "q", 100, 106, 1), (2, "c", 10, 20, "q", 50, 60, -1)]
    track, query = dense(40, runs), np.zeros(200)
    for _, _, ts, te, _, qs, qe, strand in blocks:
        query[qs:qe] = track[ts:te][::strand]
    df = spark.createDataFrame([("c", *r) for r in runs], "chrom string, start bigint, end bigint, value double")
    bl = spark.createDataFrame(blocks, "blockid bigint, tchrom string, tstart bigint, tend bigint, qchrom string, qstart bigint, qend bigint, qstrand int")
    got = dense(200, [(r["start"], r["end"], r["value"]) for r in sg.map_signal(df, bl).collect()])
    assert (got == query).all()


def test_feature_names():
    assert nm.classes_of(["ftdnm_abs_medprob", "ftkmf_pct_kAC", "ftmsig_x_abs_mean", "ftdrv_y"]) == ["dnm", "drv", "kmf", "msig"]
    with pytest.raises(ValueError):
        nm.class_of("ftzzz_abs")
    columns = ["name", "ftgc_pct_GC", "ftlen_abs_length", "ftdnm_abs_medad"]
    assert nm.select_features(columns, ["dnm", "gc"]) == (["ftdnm_abs_medad", "ftgc_pct_GC"], [])
    assert nm.select_features(columns, drop="GC") == (["ftdnm_abs_medad", "ftlen_abs_length"], ["ftgc_pct_GC"])
    assert nm.select_features(columns, keep="GC")[0] == ["ftgc_pct_GC"]
    assert nm.available_from_sequence(["roi", "gc"]) == ["gc"]
    assert nm.bed_order(["x", "score", "end", "start", "chrom"]) == ["chrom", "start", "end", "score", "x"]
    assert nm.group_path("a", "chr1") == "/a/chr1" and nm.group_path("/a/chr1", "chr1") == "/a/chr1"
    assert nm.flatten_nested(["a", ["b", ["c", 1]]]) == ["a", "b", "c", 1]
    assert nm.assembly_name("", "/x/hg19.chrom.sizes") == "hg19"
    assert nm.suspicious_headers(["1.5", "name", "e4"]) == ["1.5", "e4"]


def test_merge_checks_and_bounds(spark, rows):
    left = spark.createDataFrame([("c", "a", 0, 5, 1), ("c", "b", 7, 9, 2)], "chrom string, name string, start bigint, end bigint, v int")
    right = spark.createDataFrame([("c", "b", 6, 8, 3), ("c", "a", 1, 9, 4)], "chrom string, name string, start bigint, end bigint, v int")
    got = tb.merge_tables([left, right], ["A", "B"], ["chrom", "name"])
    assert rows(got, "name", "start", "end", "v_A", "v_B") == [("a", 0, 9, 1, 4), ("b", 6, 9, 2, 3)]
    with pytest.raises(ValueError, match="not shared"):
        tb.merge_tables([left, right.withColumn("name", F.lit("z"))], ["A", "B"], ["chrom", "name"])
    with pytest.raises(ValueError, match="different number"):
        tb.merge_tables([left, right.limit(1)], ["A", "B"], ["chrom", "name"])


def test_extend_and_stack(spark, rows):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    values = spark.createDataFrame([("a", 10), ("z", 30)], "name string, v int")
    out = tb.extend_table(left, values, ["name"], ["v"], "V", whole_genome=True, ignore_missing=True)
    assert rows(out) == [("a", 1, 10)]
    stacked = tb.stack_tables([left, left.withColumn("w", F.lit(None).cast("int"))], ["A", "B"], indicator=True)
    assert rows(stacked) == [("A", "a", 1), ("A", "b", 2)]


def test_targets(spark):
    df = spark.createDataFrame([(1.0, 2), (3.0, 4)], "x double, y int")
    out, name, kind = tb.add_target(df, expression='"data.x > 2"')
    assert (name, kind, [r["target"] for r in out.orderBy("x").collect()]) == ("target", "bool/int8", [0, 1])
    assert tb.add_target(df, column="y")[2] == "int/int64"
    with pytest.raises(ValueError, match="distinct"):
        tb.add_target(df, expression="data.x > 99")
    with pytest.raises(TypeError):
        tb.add_target(df.withColumn("s", F.concat("x", "y")), column="s")


def test_greedy_pairs_equal_sequential(spark):
    rng = random.Random(4)
    pairs = [(f"c{i}", f"t{j}", round(rng.random(), 2)) for i, j in itertools.product(range(15), range(12)) if rng.random() < 0.5]
    want, used = [], set()
    for d, i, j in sorted((d, i, j) for i, j, d in pairs):
        if i not in used and j not in used:
            want.append((i, j, d))
            used |= {i, j}
    df = spark.createDataFrame(pairs, "id string, target_id string, dist double")
    assert sorted(tuple(r) for r in greedy_pairs(df).collect()) == sorted(want)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    make = lambda p, n: [(f"{p}{i}", rng.choice([0.0, rng.uniform(-4, 4)]), rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(n)]
    cand, targ = make("c", 80), make("t", 60)
    cand += [("c_far", 90.0, 90.0, 90.0)]
    schema = "id string, x double, y double, z double"
    got = {r["id"]: (r["target_id"], r["dist"]) for r in nearest_within(spark.createDataFrame(cand, schema), spark.createDataFrame(targ, schema), ["x", "y", "z"], [0.5, 1, 3]).collect()}
    want = {}
    for c in cand:
        d, t = min((max(abs(a - b) for a, b in zip(c[1:], t[1:])), t[0]) for t in targ)
        if d <= 3:
            want[c[0]] = (t, pytest.approx(d))
    assert got == want


def test_background_matching(spark):
    rng = random.Random(10)
    genome = "".join(rng.choice("ACGTacgt") for _ in range(60_000))
    chunks = ft.chunk_sequences(spark.createDataFrame([("chr1", genome)], "chrom string, seq string"))
    sizes = spark.createDataFrame([("chr1", len(genome))], "chrom string, size bigint")
    fg = spark.createDataFrame([("chr1", s, s + 200, f"r{i}", i) for i, s in enumerate(range(12_000, 50_000, 6_000))], "chrom string, start bigint, end bigint, name string, index bigint")
    found, background = match_background(fg, sizes, chunks, ["len", "gc", "rep"], relax_init=20.0, relax_step=10.0, relax_limit=60.0, max_rounds=4, seed=1)
    rows = background.collect()
    assert rows and len({r["index"] for r in rows}) == len(rows)
    placed = sorted([(r["start"], r["end"]) for r in rows] + [(r["start"], r["end"]) for r in fg.collect()])
    assert all(a[1] <= b[0] for a, b in zip(placed, placed[1:])) and placed[0][0] >= 10_000
    assert all(genome[r["start"] : r["end"]] == r["seq"] for r in rows)
    assert found.count() == fg.count()


def test_smoothing_keeps_cubics_and_short_windows(spark):
    pos = np.arange(0, 130)
    cubic = 5 + 0.1 * pos - 0.002 * pos**2 + 1e-5 * pos**3
    df = spark.createDataFrame([("c", int(p), float(v)) for p, v in zip(pos, cubic)], "chrom string, pos bigint, value double")
    got = np.array([r["value"] for r in sg.smooth_signal(df, 5, boundary=20).orderBy("pos").collect()])
    np.testing.assert_allclose(got, np.clip(cubic, 0, None), atol=1e-6)
    noisy = df.withColumn("value", F.when(F.col("pos") % 2 == 0, 11.0).otherwise(9.0))
    raw = np.where(pos % 2 == 0, 11.0, 9.0)
    out = np.array([r["value"] for r in sg.smooth_signal(noisy, 5, boundary=20).orderBy("pos").collect()])
    # outside complete windows nothing changes; inside, the residual is orthogonal to the cubics
    assert (out[:20] == raw[:20]).all() and (out[120:] == raw[120:]).all()
    for lo in (20, 70):
        rest, x = (raw - out)[lo : lo + 50], np.arange(50) / 50
        assert rest.any() and max(abs(rest @ x**k) for k in range(4)) < 1e-8
    below = spark.createDataFrame([("c", 0, -1.0)], "chrom string, pos bigint, value double")
    assert sg.smooth_signal(below, 5, boundary=20).first()["value"] == 0


def test_estimate_windows(spark, rows):
    sizes = spark.createDataFrame([("c", 107), ("d", 20)], "chrom string, size bigint")
    assert rows(ft.estimate_windows(sizes, 25, 30)) == [("c", 30, 55), ("c", 55, 80)]


@pytest.mark.parametrize("k", [1, 3, 6, 30])
def test_words_of_texts_are_counted_without_a_row_for_each(spark, k):
    """Odd letters, empty and short texts, words too many to number by their letters; no Generate of positions in the plan."""
    texts = ["ACGTACGTACGTACGTACGTACGTACGTACGTACGT", "", "AC", "N" * 40, "A\0C\u00dfG\U0001f600T" * 9, "".join(map(chr, range(65, 300)))]
    row, words, n = sq.count_words(texts, k)
    want = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - k + 1):
            want[i, t[at : at + k]] = want.get((i, t[at : at + k]), 0) + 1
    assert {(i, w): c for i, w, c in zip(row.tolist(), words.to_pylist(), n.tolist(), strict=True)} == want and len(n) == len(want)
    plan = sq.kmer_counts(one_sequence(spark), ["chrom"], k)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sequence(1, (length(_s" not in plan


def test_dnase_row_ids_span_batches(spark):
    """Many row ids, some with several sequences, in batches smaller than the hexamers of one; equal to numpy."""
    rng = random.Random(8)
    data = [(i % 30, str(i % 2), "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([3, 60, 300])))) for i in range(50)]
    probs = {}
    for a, b, text in data:
        up = text.upper()
        words = [up[i : i + 6] for i in range(len(up) - 5) if "N" not in up[i : i + 6]]
        probs.setdefault((a, b), []).extend(np.prod([sq.DNASE_HEXAMER[c][j] / 100 for j, c in enumerate(w)]) for w in words)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sq.dnase_motif(spark.createDataFrame(data, "a int, b string, seq string"), ["a", "b"]).distinct().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(probs)
    for r in got:
        p = np.array(probs[r["a"], r["b"]] or [0.0])
        assert tuple(r)[2:] == pytest.approx((np.median(p), p.max(), np.median(np.abs(p - np.median(p)))))

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom import cli
from locusloom.plans.commands import COMMANDS
from locusloom.sources import store

ALL = r"\w+"


def run(spark, *argv):
    args = cli.parse(["--no-dump", *map(str, argv)])
    COMMANDS[args.command](spark, args)


def dense(rows, size):
    out = np.zeros(size)
    for r in rows:
        out[r["start"] : r["end"]] = r["value"]
    return out


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    """Text inputs: two signals, regions, a map, sizes and a genome."""
    rng = random.Random(1)
    d = tmp_path_factory.mktemp("work")
    (d / "aa1.sizes").write_text("chr1\t600\nchr2\t300\n")
    (d / "bb2.sizes").write_text("chr7\t500\n")
    for name in ("a", "b"):
        lines = []
        for chrom, size in (("chr1", 600), ("chr2", 300)):
            pos = 0
            while pos < size - 40:
                pos += rng.randrange(1, 20)
                end = pos + rng.randrange(1, 20)
                lines.append(f"{chrom}\t{pos}\t{end}\t{round(rng.uniform(0.1, 9), 2)}\n")
                pos = end
        (d / f"{name}.bg").write_text("".join(lines))
    (d / "r.bed").write_text("".join(f"chr{1 + i % 2}\t{i * 20}\t{i * 20 + 15}\treg{i}\t{i % 7}\n" for i in range(14)))
    (d / "s.bed").write_text("chr1\t5\t60\nchr1\t70\t90\nchr2\t1\t200\n")
    blocks = [("chr1", 10, 60, "chr7", 100, 150, "+"), ("chr1", 100, 180, "chr7", 200, 280, "-"), ("chr2", 0, 50, "chr7", 300, 350, "+")]
    (d / "m.tsv").write_text("".join(f"{t}\t{a}\t{b}\t+\t{i}\t{q}\t{x}\t{y}\t{s}\n" for i, (t, a, b, q, x, y, s) in enumerate(blocks)))
    (d / "hits").write_text("".join(f"chr1 {b} {b + 50} chr1 {b} {b + 9} M{b % 100 // 50} 9\n" for b in range(0, 600, 50)))
    (d / "db").write_text("M0 M1\n")
    (d / "asc.tsv").write_text("name\tchrom\tstarts\tends\nreg0\tchr1\t100,5\t140,9\n")
    return d


def clipped(path, chrom, size, pct):
    out = np.zeros(size)
    for line in path.read_text().splitlines():
        c, s, e, v = line.split()
        if c == chrom:
            out[int(s) : int(e)] = float(v)
    return np.clip(out, 0, np.percentile(out, pct))


@pytest.fixture(scope="module")
def stores(spark, work):
    for name in "ab":
        run(spark, "convert", "-tk", "signal", "-i", work / f"{name}.bg", "-o", work / f"{name}.sig", "-cs", work / "aa1.sizes", "-slc", ALL, "-cl", 90)
    run(spark, "convert", "-tk", "region", "-i", work / "r.bed", "-o", work / "r.reg", "-nix", 3, "-six", 4, "-topk", 80, "-slc", ALL)
    run(spark, "convert", "-tk", "region", "-i", work / "s.bed", "-o", work / "s.reg", "-slc", ALL)
    run(spark, "convert", "-tk", "map", "-i", work / "m.tsv", "-o", work / "m.map", "-tchr", work / "aa1.sizes", "-qchr", work / "bb2.sizes", "-idxc", 4, "-slc", ALL)
    run(spark, "convert", "-tk", "tfmotif", "-i", work / "hits", "-o", work / "motifs", "-mdb", work / "db", "-dbf", "list")
    genome = "".join(random.Random(5).choice("ACGTacgt") for _ in range(900))
    rows = [("chr1", genome[:600]), ("chr2", genome[600:])]
    spark.createDataFrame(rows, "chrom string, seq string").write.parquet(str(work / "genome"))
    return work


def test_signal_is_clipped(spark, stores):
    for chrom, size in (("chr1", 600), ("chr2", 300)):
        got = dense(store.read_group(spark, str(stores / "a.sig"), "", chrom + "$").collect(), size)
        np.testing.assert_allclose(got, clipped(stores / "a.bg", chrom, size, 90))
    md = {r["chrom"]: r for r in store.read_metadata(spark, str(stores / "a.sig")).collect()}
    assert md["chr1"]["length"] == 600 and md["chr1"]["signaltype"] == "values" and md["chr1"]["srcfile"] == "a.bg"


@pytest.mark.parametrize("flags, fold", [(["-nq", "-ms", "max"], np.max), (["-nq", "-ms", "median"], np.median), (["-nq"], np.mean)])
def test_signal_merge(spark, stores, tmp_path, flags, fold):
    run(spark, "convert", "-tk", "signal", "-i", stores / "a.bg", stores / "b.bg", "-o", tmp_path / "o", "-cs", stores / "aa1.sizes", "-slc", ALL, "-cl", 100, *flags)
    got = dense(store.read_group(spark, str(tmp_path / "o"), "", "chr1").collect(), 600)
    want = fold([clipped(stores / f"{n}.bg", "chr1", 600, 100) for n in "ab"], axis=0)
    np.testing.assert_allclose(got, want)


def test_signal_qnorm_and_deciles(spark, stores, tmp_path):
    run(spark, "convert", "-tk", "signal", "-i", stores / "a.bg", stores / "b.bg", "-o", tmp_path / "q", "-cs", stores / "aa1.sizes", "-slc", ALL, "-drk")
    rows = store.read_group(spark, str(tmp_path / "q")).collect()
    assert {type(r["value"]) for r in rows} == {int} and {r["value"] for r in rows} == set(range(1, 11))
    assert store.read_metadata(spark, str(tmp_path / "q")).first()["signaltype"] == "pctranks"


def test_regions_are_filtered_and_numbered(spark, stores, rows):
    scores = [i % 7 for i in range(14)]
    limit = np.percentile(scores, 20)
    want = sorted((f"chr{1 + i % 2}", i * 20, i * 20 + 15, f"reg{i}") for i in range(14) if scores[i] >= limit)
    assert rows(store.read_group(spark, str(stores / "r.reg")), "chrom", "start", "end", "name") == want
    assert rows(store.read_group(spark, str(stores / "s.reg")), "name") == [("region_0",), ("region_1",), ("region_2",)]


def test_two_region_files_merge(spark, stores, tmp_path, rows):
    run(spark, "convert", "-tk", "region", "-i", stores / "s.bed", stores / "s.bed", "-o", tmp_path / "o", "-slc", ALL)
    got = rows(store.read_group(spark, str(tmp_path / "o")), "chrom", "start", "end", "name")
    assert got == [("chr1", 5, 60, "region_0"), ("chr1", 70, 90, "region_1"), ("chr2", 1, 200, "region_2")]


def test_map_container(spark, stores, rows, capsys):
    path = str(stores / "m.map")
    assert store.dataset_kind(spark, path) == "map" and store.assembly_of_map(spark, path, "query") == "bb2"
    assert rows(store.sizes_from_map(spark, path, "target")) == [("chr1", 600), ("chr2", 300)]
    run(spark, "dump", "-i", path, "-o", "stdout", "-mapref", "query", "-fb")
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "chr7\t100\t150\t+\t0\tchr1\t10\t60\t+" and len(out) == 3


def test_lift_over(spark, stores, tmp_path):
    run(spark, "mapsig", "-i", stores / "a.sig", "-map", stores / "m.map", "-mapref", "query", "-o", tmp_path / "l", "-slc", ALL)
    got = dense(store.read_group(spark, str(tmp_path / "l")).collect(), 500)
    one, two = (clipped(stores / "a.bg", c, n, 90) for c, n in (("chr1", 600), ("chr2", 300)))
    want = np.zeros(500)
    want[100:150], want[200:280], want[300:350] = one[10:60], one[100:180][::-1], two[0:50]
    np.testing.assert_allclose(got, want)
    assert store.read_metadata(spark, str(tmp_path / "l")).first()["length"] == 500


def test_norm_writes_one_container_per_input(spark, stores, tmp_path):
    run(spark, "norm", "-i", stores / "a.sig", stores / "b.sig", "-od", tmp_path)
    got = [dense(store.read_group(spark, str(tmp_path / f"{n}.norm.sig"), "", "chr2").collect(), 300) for n in "ab"]
    raw = np.array([np.round(clipped(stores / f"{n}.bg", "chr2", 300, 90), 3) for n in "ab"])
    used = raw.sum(axis=0) > 0
    # both samples take values from one list of means
    assert (got[0][~used] == 0).all()
    assert set(np.round(got[0][used], 3)) & set(np.round(got[1][used], 3))
    order = np.argsort(raw[0][used], kind="stable")
    assert (np.diff(got[0][used][order]) >= -1e-9).all()


@pytest.mark.parametrize("task", ["cons", "roi", "active", "full"])
def test_corr(spark, stores, tmp_path, task):
    run(spark, "corr", "-t", task, "-ms", "pearson", "spearman", "-ia", stores / "a.sig", "-ib", stores / "b.sig", "-map", stores / "m.map", "-mref", "target", "-roi", stores / "s.bed", "-o", tmp_path / "c.json")
    doc = json.loads((tmp_path / "c.json").read_text())
    found = dict(doc["correlations"])
    a, b = (clipped(stores / f"{n}.bg", "chr1", 600, 90) for n in "ab")
    if task in ("full", "active"):
        on = np.ones(600, bool) if task == "full" else (a > 0) | (b > 0)
        assert found["chr1"]["pearson"]["stat"] == pytest.approx(np.corrcoef(a[on], b[on])[0, 1])
        assert 0 <= found["chr1"]["pearson"]["pv"] <= 1
    else:
        segments = [(10, 60), (100, 180)] if task == "cons" else [(10, 60)]
        assert found["chr1"]["num_regions"] == len(segments)
        assert found["chr1"]["sig1_mean_max"] == pytest.approx(max(round(a[s:e].mean(), 2) for s, e in segments))


def test_eval_reports_each_pair_and_the_genome(spark, stores, tmp_path):
    run(spark, "eval", "-i", f"R::{stores / 'r.reg'}", f"S::{stores / 's.reg'}", "-o", tmp_path / "e.json")
    doc = {d["chrom"]: d["stats"]["R_vs_S"] for d in json.loads((tmp_path / "e.json").read_text())}
    assert set(doc) == {"chr1", "chr2", "wg"}
    assert doc["wg"]["R_num"] == doc["chr1"]["R_num"] + doc["chr2"]["R_num"]
    run(spark, "eval", "-i", stores / "r.reg", stores / "s.reg", "-roi", stores / "s.reg", "-o", tmp_path / "f.json", "--mode", "overlap")
    assert json.loads((tmp_path / "f.json").read_text())[0]["roi_info"]


def test_merge_and_stack(spark, stores, tmp_path, rows):
    run(spark, "merge", "-i", f"X::{stores / 'r.reg'}", f"Y::{stores / 'r.reg'}", "-o", tmp_path / "m")
    assert set(store.read_group(spark, str(tmp_path / "m")).columns) >= {"chrom", "name", "start", "end", "start_X", "end_Y"}
    run(spark, "merge", "-jst", "-ind", "-i", stores / "r.reg", stores / "r.reg", "-o", tmp_path / "s")
    n = store.read_group(spark, str(stores / "r.reg")).count()
    assert rows(store.read_group(spark, str(tmp_path / "s")).groupBy("indicator").count()) == [("A", n)]


def test_dump_regions_and_signal(spark, stores, tmp_path, capsys):
    run(spark, "dump", "-i", stores / "s.reg", "-o", "-", "-cmh")
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("#chrom\tstart\tend\tname") and out[1].startswith("chr1\t5\t60\tregion_0")
    run(spark, "dump", "-i", stores / "s.reg", "-o", "-", "-rtab", "-noh")
    assert capsys.readouterr().out.splitlines()[0].startswith("0\tchr1\t5")
    run(spark, "dump", "-i", stores / "a.sig", "-o", tmp_path / "d.csv.gz", "-res", 50, "-stat", "mean", "-delim", ",", "-noh")
    lines = spark.read.csv(str(tmp_path / "d.csv.gz"), schema="chrom string, start long, end long, value double").collect()
    sig = clipped(stores / "a.bg", "chr1", 600, 90)
    for r in lines:
        if r["chrom"] == "chr1":
            assert r["value"] == pytest.approx(sig[r["start"] : r["end"]].mean())
    run(spark, "info", "-i", stores / "s.reg")
    assert "Groups ['default']" in capsys.readouterr().out


@pytest.fixture(scope="module")
def features(spark, stores):
    run(
        spark, "compfeat", "-tk", "classify", "-i", stores / "r.reg", "-o", stores / "f.feat", "-og", "scan", "-slc", ALL, "-map", stores / "m.map", "-mapref", "target",
        "-ft", "len", "gc", "rep", "kmf", "dnm", "tfm", "msig", "roi", "asc", "-km", 1, "-sf", stores / "genome", "-tfm", stores / "motifs", "-sigf", f"sg::{stores / 'aa1_a.sig'}",
        "-roif", f"ro::{stores / 'aa1_s.reg'}", "-asc", f"as::{stores / 'aa1_asc.tsv'}",
    )
    return stores


@pytest.fixture(scope="module", autouse=True)
def named_inputs(stores):
    """Feature inputs carry the assembly in their name."""
    for old, new in (("a.sig", "aa1_a.sig"), ("s.reg", "aa1_s.reg"), ("asc.tsv", "aa1_asc.tsv")):
        if not (stores / new).exists():
            (stores / new).symlink_to(stores / old)


def test_compfeat_classify(spark, features):
    df = store.read_group(spark, str(features / "f.feat"))
    got = {r["name"]: r.asDict() for r in df.collect()}
    assert len(got) == store.read_group(spark, str(features / "r.reg")).count()
    row = got["reg2"]
    sig = clipped(features / "a.bg", "chr1", 600, 90)
    assert row["ftlen_abs_length"] == 15 and row["ftmsig_sg_pct_cons"] == 100
    assert row["ftmsig_sg_abs_mean"] == pytest.approx(sig[40:55].mean())
    assert sum(row[f"ftkmf_pct_k{c}"] for c in "ACGTN") == pytest.approx(100)
    assert row["ftroi_ro_bin_obs"] == 1 and "fttfm_pct_M0" in row and "ftasc_as_sg_abs_nx-max" in row
    md = store.read_metadata(spark, str(features / "f.feat")).first()
    assert md["features"].startswith("len,gc") and store.dataset_kind(spark, str(features / "f.feat")) == "features"


def test_compfeat_windows(spark, stores, tmp_path):
    run(spark, "compfeat", "-tk", "classify", "-i", stores / "s.reg", "-o", tmp_path / "w", "-og", "win", "-slc", ALL, "-ft", "gc", "len", "-sf", stores / "genome", "-win", 20, "-stp", 10)
    df = store.read_group(spark, str(tmp_path / "w"))
    assert "source" in df.columns and df.filter("source = 'region_0'").count() == 4


SPECS = {
    "tree": {"model_name": "DecisionTreeClassifier", "model_type": "classifier", "store_attributes": ["feature_importances_"], "default": {"class_weight": "balanced"}, "cvtune": {"scoring": "f1_score", "min_samples_leaf": [1, 2], "presort": [True]}},
    "logit": {"model_name": "LogisticRegression", "model_type": "classifier", "store_attributes": ["coef_", "intercept_"], "default": {"penalty": "l2", "C": 1}, "cvtune": {"scoring": "roc_auc", "C": [0.5, 1], "penalty": ["l2"]}, "preprocess": True},
    "forest": {"model_name": "RandomForestRegressor", "model_type": "regressor", "default": {"n_estimators": 5}, "cvtune": {"scoring": "kendall_tau", "n_estimators": [3, 5]}},
}


@pytest.fixture(scope="module")
def training(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("train")
    rng = random.Random(3)
    rows = [("chr1", i * 10, i * 10 + 10, f"n{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, name string, ftgc_pct_GC double, ftcpg_pct_CpG double")
    df = df.withColumn("y", F.col("ftgc_pct_GC") * 2 - F.col("ftcpg_pct_CpG"))
    store.write_group(df, str(d / "t"), "g", store.region_metadata(df, "g", ["x.bed"]))
    for name, spec in SPECS.items():
        (d / f"{name}.json").write_text(json.dumps(spec))
    return d


@pytest.mark.parametrize("name", list(SPECS))
def test_train_and_apply(spark, training, tmp_path, name):
    target = ["-var", "y"] if name == "forest" else ["-drv", "data.y > 0"]
    tune = [] if name == "tree" else ["-nt"]
    run(spark, "train", "-i", training / "t", "-ms", training / f"{name}.json", "-mo", tmp_path / "m.model", "-cv", 3, *target, *tune)
    doc = json.loads((tmp_path / "m.json").read_text())
    assert doc["model_info"]["tuned"] == (name == "tree") and doc["feature_info"]["classes"] == ["cpg", "gc"]
    scoring = {"tree": "f1_score", "logit": "roc_auc", "forest": "kendall_tau"}[name]
    run(spark, "apply", "-t", "test", "-i", training / "t", "-o", tmp_path / "r.json", "-mdf", tmp_path / "m.model", "-sc", scoring, "-nump", 3)
    report = json.loads((tmp_path / "r.json").read_text())["testing_info"]
    assert report["performance"] > 0.6
    stats = report["permutation_test"]["perm_stats"]
    assert stats["perm_min"] <= stats["perm_median"] <= stats["perm_max"] < report["performance"]
    run(spark, "apply", "-t", "est", "-i", training / "t", "-o", tmp_path / "n.json", "-mdf", tmp_path / "m.model", "-sub", "ftgc_pct_GC > 0")
    assert 0 < spark.read.parquet(str(tmp_path / "n.json.predictions")).count() < 120


def test_balance_weights_subset_and_merge_of_windows(spark, training, tmp_path):
    (tmp_path / "w.tsv").write_text("name\tweight\n" + "".join(f"n{i}\t{1 + i % 3}\n" for i in range(120)))
    (tmp_path / "sub.json").write_text(json.dumps({"subset": [f"n{i}" for i in range(100)]}))
    run(spark, "train", "-i", training / "t", "-ms", training / "tree.json", "-mo", tmp_path / "m.model", "-nt", "-drv", "data.y > 0", "-bal", "-smp", 30, "-swt", tmp_path / "w.tsv", "-sub", tmp_path / "sub.json", "-cwt", "-cv", 2)
    doc = json.loads((tmp_path / "m.json").read_text())
    assert doc["dataset_info"]["num_samples"] == 60
    assert spark.read.csv(str(tmp_path / "m.model.weights"), header=True, sep="\t").count() == 60
    run(spark, "apply", "-t", "est", "-i", training / "t", "-o", tmp_path / "n.json", "-mdf", tmp_path / "m.model", "-red", 1)
    merged = spark.read.parquet(str(tmp_path / "n.json.regions"))
    assert merged.columns == ["chrom", "start", "end", "name", "class_prob"] and merged.filter("class_prob < 0.5").isEmpty()


def test_match_writes_both_groups(spark, tmp_path):
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGTacgt") for _ in range(40_000))
    spark.createDataFrame([("chr1", genome)], "chrom string, seq string").write.parquet(str(tmp_path / "genome"))
    (tmp_path / "r.bed").write_text("".join(f"chr1\t{s}\t{s + 300}\n" for s in range(12_000, 30_000, 6_000)))
    run(spark, "convert", "-tk", "region", "-i", tmp_path / "r.bed", "-o", tmp_path / "r.reg", "-og", "fg", "-slc", ALL)
    run(spark, "match", "-i", tmp_path / "r.reg", "-o", tmp_path / "o", "-og", "bg", "-2bg", tmp_path / "genome", "-ri", 20, "-rs", 20, "-rl", 60, "--rounds", 3, "-sp")
    assert store.list_groups(spark, str(tmp_path / "o")) == ["bg", "fg"]
    fg, bg = (store.read_group(spark, str(tmp_path / "o"), g) for g in ("fg", "bg"))
    assert fg.count() == bg.count() > 0
    run(spark, "compfeat", "-tk", "matched", "-i", tmp_path / "o", "-pig", "fg", "-nig", "bg", "-o", tmp_path / "p", "-slc", ALL, "-ft", "gc", "len", "-sf", tmp_path / "genome", "-ads")
    assert store.list_groups(spark, str(tmp_path / "p")) == ["neg", "pos"]


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c.ini").write_text("[RUN]\nclip = 50\nmergestat = max\n")
    args = cli.parse(["-cfg", str(tmp_path / "c.ini"), "-ofm", "append", "-dmp", str(tmp_path / "out"), "convert", "-tk", "signal", "-i", "x", "-o", "y"])
    assert args.mergestat == "max" and float(args.clip) == 50 and args.filemode == "a"
    path = cli.dump_configuration(args)
    assert "mergestat = max" in open(path).read() and path.endswith("_convert.ini")

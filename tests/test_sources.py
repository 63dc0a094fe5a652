import bz2
import gzip
import struct

import pytest
from pyspark.sql import functions as F

from locusloom.model import DatasetRef
from locusloom.operators import intervals as iv
from locusloom.operators.features import attach_sequence, chunk_sequences
from locusloom.plans.convert import convert_chain, convert_motifs
from locusloom.sources import store, text
from locusloom.sources.chain import chain_index, check_chains, chrom_sizes_from_chain, parse_chain_lines, read_chain
from locusloom.sources.twobit import read_twobit, twobit_sizes

# chains of a public human to mouse alignment with shortened chromosomes
CHAINS = """chain 12 chr16 1000 + 581 949 chr8 2500 - 1820 2341 612448
1   174 305
4   0   1
4   0   1
1   97  95
1   85  107
1

chain 0 chr21 1000 + 826 916 chr10 1000 + 555 644 50921
5   13  11
1   30  33
3   6   6
2   28  26
2

chain 8 chr14 1000 + 845 915 chr14 4050 + 3937 4001 256715
3   42  41
2   1   0
2   17  13
3

chain 44 chr14 1000 + 218 508 chr2 10000 + 8864 9142 188346
1       40      40
1       137     124
1       100     101
10

chain 9 chrX 155270560 + 114559207 114559208 chrX_random 1785075 - 1331258 1331259 326536
1
"""

MERGED = {
    "chr16": [(581, 582), (756, 765), (862, 863), (948, 949)],
    "chr21": [(826, 831), (844, 845), (875, 878), (884, 886), (914, 916)],
    "chr14": [(218, 219), (259, 260), (397, 398), (498, 508), (845, 848), (890, 892), (893, 895), (912, 915)],
}


@pytest.fixture
def chain_file(tmp_path):
    path = tmp_path / "test.chain"
    path.write_text(CHAINS)
    return str(path)


def test_chain_blocks_merge_to_the_known_intervals(spark, chain_file):
    blocks = read_chain(spark, chain_file, qselect=r"(chr)?[0-9]+(\s|$)")
    target = blocks.select(F.col("tchrom").alias("chrom"), F.col("tstart").alias("start"), F.col("tend").alias("end"))
    found = {}
    for r in iv.merge_overlapping(target).orderBy("chrom", "start").collect():
        found.setdefault(r["chrom"], []).append((r["start"], r["end"]))
    assert found == MERGED


def test_chain_runs_alternate_and_start_masked(spark, chain_file):
    blocks = read_chain(spark, chain_file, tselect="chr21$")
    target = blocks.select(F.col("tchrom").alias("chrom"), F.col("tstart").alias("start"), F.col("tend").alias("end"))
    sizes = spark.createDataFrame([("chr21", 1000)], "chrom string, size bigint")
    runs = iv.runs_and_select(target, sizes).orderBy("start").collect()
    assert [r["conserved"] for r in runs] == [i % 2 == 1 for i in range(len(runs))]
    assert runs[0]["start"] == 0 and runs[-1]["end"] == 1000 and not runs[-1]["conserved"]


def test_converted_chains_have_unique_ids_in_file_order(spark, chain_file):
    blocks, _ = convert_chain(spark, chain_file, "chr", "hg", "mm")
    known = read_chain(spark, chain_file, tselect="chr", qselect="chr")
    got = [(r.tchrom, r.tstart, r.tend, r.qchrom, r.qstart, r.qend) for r in blocks.orderBy("blockid").collect()]
    want = [(r.tchrom, r.tstart, r.tend, r.qchrom, r.qstart, r.qend) for r in known.collect()]
    assert sorted(got) == sorted(want) and dict(blocks.dtypes)["blockid"] == "bigint"
    assert blocks.select("blockid").distinct().count() == len(want)
    order = [line.split()[2] for line in CHAINS.splitlines() if line.startswith("chain")]
    assert list(dict.fromkeys(g[0] for g in got)) == list(dict.fromkeys(order))


@pytest.mark.parametrize("name", ["7", "92233720368547758"])  # a long id overflows nothing
def test_overlapping_chains_are_not_converted(spark, tmp_path, name):
    path = tmp_path / "two.chain"
    far = f"chain 5 chr21 1000 + 10 40 chr10 1000 + 10 40 {name}\n30\n\n"
    path.write_text(CHAINS + "\n" + far)
    blocks, _ = convert_chain(spark, str(path), "chr", "hg", "mm")
    assert blocks.groupBy("blockid").count().filter("count > 1").isEmpty()
    for near in ("chr21 1000 + 830 840 chr9 1000 + 1 11", "chr9 1000 + 1 11 chr10 1000 + 557 567"):  # on the target, on the query
        path.write_text(CHAINS + f"\nchain 5 {near} {name}\n10\n\n")
        with pytest.raises(ValueError, match="overlapping blocks"):
            convert_chain(spark, str(path), "chr", "hg", "mm")


def test_chains_without_selected_blocks_are_an_error(spark, chain_file):
    with pytest.raises(ValueError, match="no blocks"):
        convert_chain(spark, chain_file, "chr77$", "hg", "mm")


def test_chain_filters_and_index(spark, chain_file, rows):
    lines = text.numbered_lines(spark, chain_file)
    assert check_chains(lines).isEmpty()
    assert parse_chain_lines(lines, "chr1$").isEmpty()
    assert {r["blockid"].split(".")[0] for r in parse_chain_lines(lines, read_num=2).collect()} == {"612448", "50921"}
    assert {r["tchrom"] for r in parse_chain_lines(lines, min_score=9).collect()} == {"chr16", "chr14", "chrX"}
    reverse = parse_chain_lines(lines, "chrX$").first()
    assert (reverse["qstart"], reverse["qend"], reverse["qstrand"]) == (1785075 - 1331259, 1785075 - 1331258, -1)
    downwards = parse_chain_lines(lines, "chr16$").orderBy("tstart").collect()
    # sizes and gaps taken off 2500 - 1820, block by block
    assert [(r["qstart"], r["qend"]) for r in downwards] == [(679, 680), (370, 374), (365, 369), (363, 364), (267, 268), (159, 160)]
    assert ("chr16", 1000) in rows(chrom_sizes_from_chain(lines))
    assert ("chrX_random", 1785075) in rows(chrom_sizes_from_chain(lines, target=False))
    assert ("chr14", "chr2", 1) in rows(chain_index(lines), "tchrom", "qchrom", "n_chains")


def write_twobit(path, sequences):
    """Test helper: the packed form of named sequences."""
    head = struct.pack("<IIII", 0x1A412743, 0, len(sequences), 0)
    index_size = sum(1 + len(n) + 4 for n in sequences)
    offset, index, body = len(head) + index_size, b"", b""
    for name, seq in sequences.items():
        index += bytes([len(name)]) + name.encode() + struct.pack("<I", offset + len(body))
        record = struct.pack("<I", len(seq))
        for belongs in (lambda c: c in "Nn", lambda c: c.islower()):
            starts, sizes, i = [], [], 0
            while i < len(seq):
                j = i
                while j < len(seq) and belongs(seq[j]):
                    j += 1
                if j > i:
                    starts.append(i)
                    sizes.append(j - i)
                i = max(j, i + 1)
            record += struct.pack(f"<I{2 * len(starts)}I", len(starts), *starts, *sizes)
        record += struct.pack("<I", 0)
        codes = ["TCAG".index(c) if c in "TCAG" else 0 for c in seq.upper()]
        codes += [0] * (-len(codes) % 4)
        record += bytes(a << 6 | b << 4 | c << 2 | d for a, b, c, d in zip(*[iter(codes)] * 4))
        body += record
    path.write_bytes(head + index + body)


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_twobit_round_trip(spark, tmp_path, chunk):
    sequences = {"chr1": "ACGTNNNNacgtnnTTTGGGCCCaAaA" * 5, "chr2": "T", "scaffold": "gattaca"}
    write_twobit(tmp_path / "g.2bit", sequences)
    found = {}
    for r in read_twobit(spark, str(tmp_path / "g.2bit"), chunk).orderBy("chrom", "chunk").collect():
        found[r["chrom"]] = found.get(r["chrom"], "") + r["seq"]
    # an unknown base stays N; case marks repeats and is kept on N
    assert {k: v.upper() for k, v in found.items()} == {k: v.upper() for k, v in sequences.items()}
    assert found["scaffold"] == "gattaca" and found["chr1"][8:12] == "acgt"
    only = read_twobit(spark, str(tmp_path / "g.2bit"), chunk, "chr2$").collect()
    assert [(r["chrom"], r["seq"]) for r in only] == [("chr2", "T")]
    assert {r["chrom"]: r["size"] for r in twobit_sizes(spark, str(tmp_path / "g.2bit")).collect()} == {k: len(v) for k, v in sequences.items()}


def test_sequence_is_attached_across_chunks(spark, rows):
    genome = spark.createDataFrame([("c", "ACGTacgtNNGG"), ("d", "TTTT")], "chrom string, seq string")
    regions = spark.createDataFrame([("c", 0, 12), ("c", 3, 5), ("c", 3, 5), ("d", 1, 4)], "chrom string, start bigint, end bigint")
    got = rows(attach_sequence(regions, chunk_sequences(genome, 4), 4), "chrom", "start", "seq")
    assert got == [("c", 0, "ACGTacgtNNGG"), ("c", 3, "Ta"), ("c", 3, "Ta"), ("d", 1, "TTT")]
    beyond = spark.createDataFrame([("d", 2, 9)], "chrom string, start bigint, end bigint")
    with pytest.raises(Exception, match="malformed region"):
        attach_sequence(beyond, chunk_sequences(genome, 4), 4).collect()


def test_regions_keep_their_columns_where_sequence_is_attached(spark, rows):
    genome = spark.createDataFrame([("c", "ACG\u00e9acgtN\u00e9GG"), ("d", "TTTTGGGG")], "chrom string, seq string")
    regions = spark.sql(
        """select * from values ('c', 3L, 4L, 1, map('k', 1)), ('c', 8L, 11L, 2, map('k', 2)), ('c', 2L, 10L, 3, null), ('c', 2L, 10L, 3, null),
        ('d', 0L, 4L, 4, map('k', 4)), ('d', 4L, 8L, 5, map()), (null, 0L, 4L, 6, null) as r(chrom, start, end, `a.b`, m)"""
    )
    got = attach_sequence(regions, chunk_sequences(genome, 4), 4)
    assert got.columns == ["chrom", "start", "end", "a.b", "m", "seq"]
    assert rows(got, "`a.b`", F.col("m")["k"], "seq") == sorted(
        [(1, 1, "\u00e9"), (2, 2, "N\u00e9G"), (3, None, "G\u00e9acgtN\u00e9"), (3, None, "G\u00e9acgtN\u00e9"), (4, 4, "TTTT"), (5, None, "GGGG")]
    )
    for twice in ("TTTTGGGG", "CC"):
        chunks = chunk_sequences(genome.unionAll(spark.createDataFrame([("d", twice)], "chrom string, seq string")), 4)
        with pytest.raises(Exception, match="malformed region"):
            attach_sequence(regions, chunks, 4).collect()


def test_chrom_sizes_and_codecs(spark, tmp_path, rows):
    body = "chr1\t100\nchr2 200\n\nscaffold_3\t9\n"
    for name, write in (("s.txt", None), ("s.txt.gz", gzip.compress), ("s.txt.bz2", bz2.compress)):
        (tmp_path / name).write_bytes(write(body.encode()) if write else body.encode())
        assert rows(text.read_chrom_sizes(spark, str(tmp_path / name), "(chr)?[0-9]")) == [("chr1", 100), ("chr2", 200)]
    with pytest.raises(ValueError, match="no chromosomes"):
        text.read_chrom_sizes(spark, str(tmp_path / "s.txt"), "X")


def test_bed_variants(spark, tmp_path, rows):
    plain = tmp_path / "a.bed"
    plain.write_text("chr1\t10\t20\tone\t5.5\nchr2\t30\t45\ttwo\t1\n")
    got = text.read_bed(spark, str(plain), name_index=3, score_index=4)
    assert got.columns == ["chrom", "start", "end", "name", "score"]
    assert rows(got) == [("chr1", 10, 20, "one", 5.5), ("chr2", 30, 45, "two", 1.0)]
    headed = tmp_path / "b.bed"
    headed.write_text("#seq\tfrom\tto\tname\tname\nchr1\t10\t20\tone\tx\n")
    assert text.read_bed(spark, str(headed), use_header=True, name_index=3).columns == ["chrom", "start", "end", "name", "name_dup4"]
    skipped = tmp_path / "c.bed"
    skipped.write_text("chromosome,begin,finish\nchr1,10,20\n")
    assert rows(text.read_bed(spark, str(skipped))) == [("chr1", 10, 20)]
    bad = tmp_path / "d.bed"
    bad.write_text("chrom\tstart\tend\tftx\nchr1\t1\t2\t3\n")
    with pytest.raises(ValueError, match="may not start with ft"):
        text.read_bed(spark, str(bad), use_header=True)
    with pytest.raises(ValueError, match="first three"):
        text.read_bed(spark, str(plain), name_index=1)


def test_map_and_super_blocks(spark, tmp_path, rows):
    path = tmp_path / "m.tsv"
    pairs = [("chr1", "q1"), ("chr1", "q1"), ("chr2", "q1"), ("chr1", "q1")]
    path.write_text("".join(f"{t}\t{i * 10}\t{i * 10 + 5}\t+\t{i}\t{q}\t{i * 7}\t{i * 7 + 5}\t{'-' if i else '+'}\n" for i, (t, q) in enumerate(pairs)))
    blocks = text.read_map(spark, str(path), 4)
    assert rows(blocks, "blockid", "qstrand") == [(0, 1), (1, -1), (2, -1), (3, -1)]
    assert rows(text.map_super_blocks(blocks), "blockid", "super_block") == [(0, 1), (1, 1), (2, 2), (3, 3)]


def test_motifs_and_associations(spark, tmp_path, rows):
    (tmp_path / "db.meme").write_text("MEME version 4\n\nMOTIF MA1 Arnt\nx\nMOTIF MA2 Ahr\n")
    (tmp_path / "db.list").write_text("MA1 MA2\n")
    (tmp_path / "hits").write_text("c 0 250 c 1 12 MA1 11\nc 250 500 c 260 270 MA1 10\nc 0 250 c 5 9 MA1 4\n")
    assert rows(text.read_motif_names(spark, str(tmp_path / "db.meme"), "meme")) == [("MA1", "fttfm_pct_MA1-Arnt"), ("MA2", "fttfm_pct_MA2-Ahr")]
    assert ("MA1", "fttfm_pct_MA1") in rows(text.read_motif_names(spark, str(tmp_path / "db.list"), "list"))
    assert rows(text.read_binned_motifs(spark, str(tmp_path / "hits"))) == [("c", 0, "MA1", 15), ("c", 250, "MA1", 10)]
    (tmp_path / "asc.tsv").write_text("name\tchrom\tstarts\tends\ng1\tc\t1,5\t3,9\n")
    assert rows(text.read_associated(spark, str(tmp_path / "asc.tsv"))) == [("c", "g1", [1, 5], [3, 9], [1.0, 1.0])]


def test_width_of_sparse_motif_bins_is_that_of_the_lines(spark, tmp_path, rows):
    (tmp_path / "db.list").write_text("MA1\n")
    (tmp_path / "hits").write_text("c 0 250 c 1 12 MA1 11\nc 750 1000 c 760 770 MA1 10\nc 1000 1100 c 1005 1009 MA1 4\n")
    stored = convert_motifs(spark, [str(tmp_path / "hits")], str(tmp_path / "db.list"), "list")
    assert {(r["bin"], r["width"]) for r in stored.collect()} == {(0, 250), (750, 250), (1000, 250)}
    (tmp_path / "off").write_text("c 0 250 c 1 12 MA1 11\nc 300 550 c 310 320 MA1 10\n")
    with pytest.raises(Exception, match="bin off the grid"):
        convert_motifs(spark, [str(tmp_path / "off")], str(tmp_path / "db.list"), "list").collect()


def test_store_groups_append_and_kind(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("1", 0, 5, "x"), ("2", 0, 7, "y")], "chrom string, start bigint, end bigint, name string")
    store.write_group(a, path, "one", store.region_metadata(a, "one", ["f/a.bed"]))
    assert store.dataset_kind(spark, path) == "regions" and store.default_group(spark, path) == "one"
    assert rows(store.read_group(spark, path), "chrom", "start", "end", "name") == [("chr1", 0, 5, "x"), ("chr2", 0, 7, "y")]
    b = spark.createDataFrame([("1", 3, 9, "z")], "chrom string, start bigint, end bigint, name string")
    store.write_group(b, path, "two", store.region_metadata(b, "two", ["f/b.bed"]), "a")
    store.write_group(b, path, "one", store.region_metadata(b, "one", ["f/b.bed"]), "a")
    assert store.list_groups(spark, path) == ["one", "two"]
    # appending to a group replaces the chromosomes written
    assert rows(store.read_group(spark, path, "one"), "chrom", "name") == [("chr1", "z"), ("chr2", "y")]
    assert rows(store.read_metadata(spark, path), "group", "covbp") == [("/one/chr1", 6), ("/one/chr2", 7), ("/two/chr1", 6)]
    assert store.list_chroms(spark, path, verify=True) == ["chr1", "chr2"]
    with pytest.raises(ValueError, match="2 groups"):
        store.default_group(spark, path)
    with pytest.raises(KeyError):
        store.read_group(spark, path, "three")


def test_dataset_references():
    assert DatasetRef.parse("p") == DatasetRef("p")
    assert DatasetRef.parse("g:p") == DatasetRef("p", "g")
    assert DatasetRef.parse("l:auto:p") == DatasetRef("p", "", "l")
    assert [r.label for r in DatasetRef.parse_all(["p", "X:g:q"], "V")] == ["VA", "X"]
    with pytest.raises(ValueError, match="contradicts"):
        DatasetRef.parse("g:p", "h")
    with pytest.raises(ValueError, match="label:group:path"):
        DatasetRef.parse_feature("g:p")
    with pytest.raises(ValueError, match="assembly"):
        DatasetRef.parse_feature("l:g:p", "hg19")


def test_maps_are_pruned_by_chromosome_pair(spark, tmp_path):
    """Folders of other pairs are not read, and the span reaches the scan."""
    rows = [(i, f"chr{i % 3}", i * 100, i * 100 + 60, f"q{i % 2}", i * 80, i * 80 + 60, 1) for i in range(60)]
    blocks = spark.createDataFrame(rows, "blockid long, tchrom string, tstart long, tend long, qchrom string, qstart long, qend long, qstrand int")
    sizes = spark.createDataFrame([("chr0", 9999)], "chrom string, size bigint")
    path = str(tmp_path / "map")
    store.write_map(blocks, path, store.map_metadata(spark, "t", "q", "md5", "", sizes, sizes, False))
    some = store.read_blocks(spark, path, targets="chr[12]", chroms=(None, ["q1"]), span=(1000, 4000))
    want = sorted(r[0] for r in rows if r[1] in ("chr1", "chr2") and r[4] == "q1" and r[2] < 4000 and r[3] > 1000)
    assert sorted(r.blockid for r in some.collect()) == want
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "qside" in filters[: filters.index("PushedFilters")] and "chrom" in filters[: filters.index("PushedFilters")]
    assert "LessThan(tstart,4000)" in filters
    read = {r.f.split("chrom=")[1].split("/part")[0] for r in some.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read == {"chr1/qside=q1", "chr2/qside=q1"}
    assert sorted(r["chrom"] for r in store.conserved_blocks(spark, path, "query", ["q0"]).select("chrom").distinct().collect()) == ["q0"]
    assert store.read_blocks(spark, path).count() == 60


def test_rows_are_made_once_and_read_from_what_they_replace(spark, tmp_path):
    """Metadata come from the stored rows: each row of the pipeline is made once, also where it reads the same container."""
    path, made = str(tmp_path / "box"), spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    count = F.udf(seen, "bigint").asNondeterministic()
    df = spark.range(50).select(F.concat(F.lit("chr"), F.col("id") % 3).alias("chrom"), count(F.col("id") * 10).alias("start")).withColumn("end", F.col("start") + 5)
    store.write_group(df, path, "g", lambda rows: store.region_metadata(rows, "g", ["x"]))
    assert made.value == 50
    assert {r["chrom"]: (r.numreg, r.covbp) for r in store.read_metadata(spark, path).collect()} == {"chr0": (17, 85), "chr1": (17, 85), "chr2": (16, 80)}
    some = store.read_group(spark, path, "g", "chr[01]").filter("start < 100")
    store.write_group(some, path, "g", lambda rows: store.region_metadata(rows, "g", ["y"]), "a")
    assert {r["chrom"]: r.numreg for r in store.read_metadata(spark, path).collect()} == {"chr0": 4, "chr1": 3, "chr2": 16}


def test_chain_lines_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(row):
        seen.add(1)
        return row

    numbered = [(i, line) for i, line in enumerate(CHAINS.split("\n"))]
    lines = spark.createDataFrame(spark.sparkContext.parallelize(numbered, 2).map(told), "line_no bigint, value string")
    same = spark.createDataFrame(numbered, "line_no bigint, value string")
    assert sorted(parse_chain_lines(lines).collect()) == sorted(parse_chain_lines(same).collect())
    assert seen.value == len(numbered)

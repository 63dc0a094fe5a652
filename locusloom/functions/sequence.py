"""Sequence features as column expressions; lower case marks repeats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workers_find_package

from .names import kmer_columns

# Core promoter motifs (name, pattern).
CORE_PROMOTER_MOTIFS = [
    ("elkM3", "[GC]CGGAAG[CT]"),
    ("sp1M6", "GGGCGG[AG]"),
    ("novelM22", "TGCGCA[ACGTN][GT]"),
    ("tataM3", "TATA[AT]AA[AG]"),
    ("inrM4", "[TC][TC]A[ACGTN][AT][TC][TC]"),
    ("breMx", "[GC][GC][AG]CGCC"),
    ("dpeM9", "[AG]G[AT][TC][GAC](T)?"),
    ("mteM10", "C[GC]A[AG]C[GC][GC]AACG[GC]"),
    ("dtieMx", "G[CGT][CGT][AG][AGT][ACGTN][ACT]GG"),
]

# Preferred DNase I cleavage hexamer, percent per position.
DNASE_HEXAMER = {
    "A": [44, 4, 28, 19, 31, 24],
    "T": [26, 39, 46, 42, 2, 20],
    "C": [7, 41, 15, 19, 33, 35],
    "G": [22, 17, 11, 20, 33, 20],
}

# finding a position in a string walks over the letters before it, hence two cuts
PIECE = 65536
SHORT_PIECE = 4096
AT_ONCE = 256  # pieces counted at once


def _count(seq: Column, letters: str) -> Column:
    # "#" maps to itself, which keeps the replacement list non-empty while the letters vanish
    return F.length(seq) - F.length(F.translate(seq, "#" + letters, "#"))


def gc_percent(seq: Column) -> Column:
    return F.try_divide(_count(seq, "GCgc"), F.length(seq)) * 100


def repeat_percent(seq: Column) -> Column:
    return F.try_divide(_count(seq, "acgt"), F.length(seq)) * 100


def cpg_count(seq: Column) -> Column:
    low = F.lower(seq)
    return ((F.length(low) - F.length(F.replace(low, F.lit("cg"), F.lit("")))) / 2).cast("bigint")


def cpg_percent(seq: Column) -> Column:
    return F.try_divide(cpg_count(seq), F.length(seq) / 2) * 100


def observed_expected_cpg(seq: Column) -> Column:
    g, c = F.greatest(F.lit(1), _count(seq, "Gg")), F.greatest(F.lit(1), _count(seq, "Cc"))
    return cpg_count(seq) / (g.cast("double") * c) * F.length(seq)


def length_feature(start: Column, end: Column, yardstick: int = 0) -> Column:
    """Region length, or its percentage of the yardstick."""
    return (end - start) / F.lit(yardstick) * 100 if yardstick > 0 else end - start


def motif_count(seq: Column, pattern: str) -> Column:
    return F.regexp_count(F.upper(seq), F.lit(pattern))


def motif_percent(seq: Column, pattern: str) -> Column:
    """Share of the sequence covered by non-overlapping matches."""
    up = F.upper(seq)
    return F.try_divide(F.length(up) - F.length(F.regexp_replace(up, pattern, "")), F.length(up)) * 100


def hexamer_probabilities(words: Sequence[str]) -> np.ndarray:
    """Product over six positions of the cleavage preference of the letter there, for words over ACGT."""
    weights = np.full((6, 128), np.nan)
    for base, percents in DNASE_HEXAMER.items():
        weights[:, ord(base)] = [p / 100.0 for p in percents]
    letters = np.frombuffer("".join(words).encode("ascii"), dtype=np.uint8).reshape(-1, 6)
    p = np.ones(len(letters))
    for i in range(6):
        p = p * weights[i, letters[:, i]]
    return p


def sequence_columns(classes: Sequence[str], yardstick: int = 0, seq: str = "seq") -> list[Column]:
    """One column per feature of the requested classes that is an expression on one row."""
    s = F.col(seq)
    out: list[Column] = []
    if "len" in classes:
        name = "ftlen_pct_length" if yardstick > 0 else "ftlen_abs_length"
        out.append(length_feature(F.col("start"), F.col("end"), yardstick).alias(name))
    if "gc" in classes:
        out.append(gc_percent(s).alias("ftgc_pct_GC"))
    if "cpg" in classes:
        out.append(cpg_percent(s).alias("ftcpg_pct_CpG"))
    if "oecpg" in classes:
        out.append(observed_expected_cpg(s).alias("ftoecpg_rat_oeCpG"))
    if "rep" in classes:
        out.append(repeat_percent(s).alias("ftrep_pct_repcon"))
    if "prm" in classes:
        for name, pattern in CORE_PROMOTER_MOTIFS:
            out.append(motif_percent(s, pattern).alias(f"ftprm_pct_{name}"))
            out.append(motif_count(s, pattern).cast("bigint").alias(f"ftprm_abs_{name}"))
    return out


def kmer_counts(df: DataFrame, ids: Sequence[str], k: int, seq: str = "seq") -> DataFrame:
    """Occurrences of each k-mer per row id, overlapping and case-blind: ``ids, kmer, n, total``.

    Sequences are cut into overlapping pieces, the words of some pieces are counted at a time in numpy, and the counts of a row
    id are added up; no row per position is made.
    """
    workers_find_package(df.sparkSession)
    pieces = (
        df.select(*ids, F.upper(F.col(seq)).alias("_s"), (F.length(seq) - k + 1).alias("total"))
        .filter(F.col("total") > 0)
        .transform(lambda d: _overlapping_pieces(d, [*ids, "total"], k, PIECE))
        .transform(lambda d: _overlapping_pieces(d, [*ids, "total"], k, SHORT_PIECE))
    )
    kept = [*ids, "total"]
    typed = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                row, words, n = count_words(some.column("_s").to_pylist(), k)
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(pa.array(row)) for c in kept], words, pa.array(n)], names=[*kept, "kmer", "n"])

    words = pieces.mapInArrow(counted, f"{typed}, kmer string, n bigint")
    return words.groupBy(*ids, "total", "kmer").agg(F.sum("n").alias("n")).select(*ids, "kmer", "n", "total")


def count_words(texts: Sequence[str], k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``row, word, n``: the distinct words of ``k`` letters of each text, overlapping, and how often they occur."""
    whole = "".join(texts)
    letters = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])  # words that lie in one text
    if len(start) == 0:
        return start, pa.array([], pa.string()), start
    row = row[start]
    known = np.flatnonzero(np.bincount(letters))
    rank = np.zeros(known[-1] + 1, dtype=np.int64)
    rank[known] = np.arange(len(known))
    code, room = rank[letters], len(known)
    word, size = code[start], room
    for i in range(1, k):
        if size * room * len(texts) >= 1 << 62:  # numbers of the words seen so far instead of their letters
            word = np.unique(word, return_inverse=True)[1]
            size = int(word.max()) + 1
        word, size = word * room + code[start + i], size * room
    key = row * size + word
    if len(texts) * size <= len(key):
        counts = np.bincount(key)
        found = np.flatnonzero(counts)
        place = np.zeros(len(counts), dtype=np.int64)
        place[key] = np.arange(len(key))
        at, n = place[found], counts[found]
    else:
        _, at, n = np.unique(key, return_index=True, return_counts=True)
    first = start[at]
    if known[-1] < 128:
        spelled = np.ascontiguousarray(letters[first[:, None] + np.arange(k)].astype(np.uint8))
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.arange(0, k * len(first) + 1, k, dtype=np.int32)), pa.py_buffer(spelled))
    else:
        words = pa.array([whole[i : i + k] for i in first.tolist()], pa.string())
    return row[at], words, n.astype(np.int64)


def _overlapping_pieces(df: DataFrame, kept: Sequence[str], k: int, size: int) -> DataFrame:
    """Cut ``_s`` into pieces that share k - 1 letters, so that each word lies in exactly one."""
    starts = F.sequence(F.lit(1), F.length("_s") - k + 1, F.lit(size))
    return df.select(*kept, "_s", F.explode(starts).alias("_at")).select(
        *kept, F.substr(F.col("_s"), F.col("_at"), F.lit(size + k - 1)).alias("_s")
    )


def kmer_frequency(df: DataFrame, ids: Sequence[str], k: int, seq: str = "seq") -> DataFrame:
    """k-mer percentages in long form."""
    return kmer_counts(df, ids, k, seq).select(*ids, "kmer", (F.col("n") / F.col("total") * 100).alias("pct"))


def kmer_table(df: DataFrame, ids: Sequence[str], k: int, seq: str = "seq") -> DataFrame:
    """Wide form: one column per word over ACGTN, zero where absent."""
    long = kmer_frequency(df, ids, k, seq).withColumn("kmer", F.concat(F.lit("ftkmf_pct_k"), "kmer"))
    columns = kmer_columns(k)
    wide = long.groupBy(*ids).pivot("kmer", columns).agg(F.max("pct"))
    return df.select(*ids).join(wide, list(ids), "left").fillna(0.0, subset=columns)


def dnase_motif(df: DataFrame, ids: Sequence[str], seq: str = "seq") -> DataFrame:
    """Median, maximum and median absolute deviation of hexamer probabilities; zeros without a hexamer.

    The hexamers of a row id, at most 4096 distinct ones of each length of its sequences, come sorted together, as many at a time
    as a batch holds.
    """
    ids = list(ids)
    names = ["ftdnm_abs_medprob", "ftdnm_abs_maxprob", "ftdnm_abs_medad"]
    words = kmer_counts(df, ids, 6, seq).filter(F.col("kmer").rlike("^[ACGT]{6}$")).select(*ids, "kmer", "n")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            begins = _begins(now, ids)
            last = int(begins[-1]) if len(begins) else 0
            if last > 0:
                yield from _hexamer_lines(now.slice(0, last), ids, begins[:-1], names)
            held = now.slice(last)
        if held is not None and held.num_rows:
            yield from _hexamer_lines(held, ids, np.zeros(1, dtype=np.int64), names)

    typed = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in ids)
    found = words.repartition(*ids).sortWithinPartitions(*ids).mapInArrow(spread, f"{typed}, " + ", ".join(f"{n} double" for n in names))
    return df.select(*ids).join(found, ids, "left").fillna(0.0, subset=names)


def _begins(rows: pa.Table, ids: Sequence[str]) -> np.ndarray:
    """Where another row id begins in rows sorted by it."""
    if rows.num_rows == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for c in ids:
        column = rows.column(c).combine_chunks()
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(before, after), False), pc.xor(before.is_null(), after.is_null()))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _hexamer_lines(rows: pa.Table, ids: Sequence[str], begins: np.ndarray, names: Sequence[str]) -> list[pa.RecordBatch]:
    """One line for each row id: weighted median and maximum of the probabilities, median of their distances from it."""
    p, n = hexamer_probabilities(rows.column("kmer").to_pylist()), rows.column("n").to_numpy()
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, rows.num_rows)))
    middle = _weighted_medians(group, begins, p, n)
    values = [middle, np.maximum.reduceat(p, begins), _weighted_medians(group, begins, np.abs(p - middle[group]), n)]
    first = rows.select(list(ids)).take(pa.array(begins))
    for name, value in zip(names, values, strict=True):
        first = first.append_column(name, pa.array(value))
    return first.combine_chunks().to_batches()


def _weighted_medians(group: np.ndarray, begins: np.ndarray, values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of each group's values, each ``n`` times; the mean of the middle two where their number is even."""
    order = np.lexsort((values, group))
    upto, sorted_values = np.cumsum(n[order]), values[order]
    total = np.add.reduceat(n, begins)
    before = np.cumsum(total) - total
    low = sorted_values[np.searchsorted(upto, before + (total - 1) // 2 + 1)]
    high = sorted_values[np.searchsorted(upto, before + total // 2 + 1)]
    return np.where(low == high, low, 0.5 * low + 0.5 * high)

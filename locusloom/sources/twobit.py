"""Spark data source for 2bit sequence files: ``spark.read.format("twobit").load(path)``.

Rows are ``chrom, chunk, seq``, the chunked form that ``attach_sequence`` joins. A partition is
a range of chunks of one sequence and reads only its own packed bytes, so a long chromosome is
read by many tasks. The path must be readable by every executor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format: signature, and the base each two-bit code stands for.
SIGNATURE = 0x1A412743
CODES = b"TCAG"

CHUNKS_PER_PARTITION = 64


@dataclass
class _Span(InputPartition):
    chrom: str
    offset: int
    first_chunk: int
    last_chunk: int


def _read_index(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Byte order and the (name, record offset) pairs of a file."""
    with open(path, "rb") as handle:
        head = handle.read(16)
        order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == SIGNATURE), None)
        if order is None:
            raise ValueError(f"{path} is not a 2bit file")
        count = struct.unpack(order + "I", head[8:12])[0]
        entries = []
        for _ in range(count):
            name = handle.read(handle.read(1)[0]).decode("ascii")
            entries.append((name, struct.unpack(order + "I", handle.read(4))[0]))
    return order, entries


class _Reader(DataSourceReader):
    def __init__(self, path: str, chunk: int, chroms: str):
        self.path, self.chunk, self.chroms = path, chunk, chroms

    def partitions(self) -> list[_Span]:
        import re

        order, entries = _read_index(self.path)
        spans = []
        with open(self.path, "rb") as handle:
            for name, offset in entries:
                if self.chroms and not re.match(self.chroms, name):
                    continue
                handle.seek(offset)
                size = struct.unpack(order + "I", handle.read(4))[0]
                n_chunks = (size + self.chunk - 1) // self.chunk
                for first in range(0, n_chunks, CHUNKS_PER_PARTITION):
                    spans.append(_Span(name, offset, first, min(n_chunks, first + CHUNKS_PER_PARTITION)))
        return spans

    def read(self, partition: _Span) -> Iterator[tuple[str, int, str]]:
        import numpy as np

        order, _ = _read_index(self.path)
        word = np.dtype(order + "u4")
        letters = np.frombuffer(CODES, dtype=np.uint8)
        with open(self.path, "rb") as handle:
            handle.seek(partition.offset)
            size = int(np.frombuffer(handle.read(4), word)[0])

            def blocks() -> tuple[np.ndarray, np.ndarray]:
                n = int(np.frombuffer(handle.read(4), word)[0])
                starts = np.frombuffer(handle.read(4 * n), word).astype(np.int64)
                return starts, starts + np.frombuffer(handle.read(4 * n), word).astype(np.int64)

            unknown, repeats = blocks(), blocks()
            handle.read(4)
            packed_at = handle.tell()
            for chunk in range(partition.first_chunk, partition.last_chunk):
                begin, end = chunk * self.chunk, min(size, (chunk + 1) * self.chunk)
                handle.seek(packed_at + begin // 4)
                packed = np.frombuffer(handle.read((end + 3) // 4 - begin // 4), np.uint8)
                codes = (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
                seq = letters[codes.reshape(-1)[begin % 4 : begin % 4 + end - begin]].copy()
                for (starts, ends), repeat in ((unknown, False), (repeats, True)):
                    for i in range(np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")):
                        part = slice(max(starts[i], begin) - begin, min(ends[i], end) - begin)
                        seq[part] = seq[part] | 0x20 if repeat else ord("N")
                yield partition.chrom, chunk, seq.tobytes().decode("ascii")


class TwoBitSource(DataSource):
    """Options: ``chunk`` (letters per row) and ``chroms`` (pattern for sequence names)."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "chrom string, chunk bigint, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("chunk", 65536)), self.options.get("chroms", ""))


def read_twobit(spark: SparkSession, path: str, chunk: int = 65536, chroms: str = "") -> DataFrame:
    """Sequences of a 2bit file as chunks; ``chroms`` keeps names that match from their start."""
    spark.dataSource.register(TwoBitSource)
    return spark.read.format("twobit").option("chunk", chunk).option("chroms", chroms).load(path)


def twobit_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, size`` from the record heads of a 2bit file."""
    order, entries = _read_index(path)
    rows = []
    with open(path, "rb") as handle:
        for name, offset in entries:
            handle.seek(offset)
            rows.append((name, struct.unpack(order + "I", handle.read(4))[0]))
    return spark.createDataFrame(rows, "chrom string, size bigint")


def read_sequences(spark: SparkSession, path: str, chunk: int = 65536) -> DataFrame:
    """Chunked sequences from a 2bit file, or from Parquet with ``chrom, seq`` or ``chrom, chunk, seq``."""
    from ..operators.features import chunk_sequences

    if path.endswith(".2bit"):
        return read_twobit(spark, path, chunk)
    stored = spark.read.parquet(path)
    return stored if "chunk" in stored.columns else chunk_sequences(stored, chunk)

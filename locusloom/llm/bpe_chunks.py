"""Byte-level BPE with reuse of content-defined chunks, exact at every join.

A text is cut where a rolling hash of its last 16 bytes ends in zeros, so copies of a passage give the
same chunks wherever they stand. A chunk's ids are computed once and remembered under its 128-bit hash.
Ids of a chunk on its own may differ from its share of the whole text only next to the cuts. They are
repaired there: the stretch from the last safe place of one chunk to the first safe place of the next
is encoded again. A safe place lies between a character that isn't white space and one that is: a token
always ends there, in the chunk as in the whole text, so both agree on all ids beyond it. If a chunk has
no safe place, the stretch grows over it until one is found.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, byte_stand_ins

MASK_BITS = 11
CHUNK_MEMORY = 64 << 20

#: White space of the tokenizer's own pattern (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(raw: bytes, bits: int = MASK_BITS) -> list[int]:
    """Byte places after which a chunk ends: content-defined, never inside a character, the end included."""
    n = len(raw)
    if n <= 16:
        return [n] if n else []
    b = np.frombuffer(raw, dtype=np.uint8)
    h = _GEAR[b]
    for shift in (1, 2, 4, 8):  # sums of 2, 4, 8, 16 bytes, older bytes shifted further
        older = h[:-shift] << np.uint32(shift)
        h = h.copy()
        h[shift:] += older
    cuts = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    cuts = cuts[(cuts > 16) & (cuts < n)]
    cuts = cuts[(b[cuts] & 0xC0) != 0x80]
    return [*cuts.tolist(), n]


class ChunkEncoder:
    """Ids of whole texts as the tokenizer gives them, with remembered chunks and pieces."""

    def __init__(self, path: str, bits: int = MASK_BITS, memory: int = CHUNK_MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bits, self.memory, self.used = bits, memory, 0
        self.pieces = Memo(self._piece, limit=500_000)
        self.chunks: OrderedDict[bytes, tuple] = OrderedDict()
        self.reused = self.encoded = 0

        # bytes of each token: the printable stand-ins of byte-level BPE turned back
        stand_in = byte_stand_ins()
        size = 1 + max([*spec["model"]["vocab"].values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(stand_in[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()

    def _piece(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, text: str) -> bytes:
        """Ids of a stretch on its own; a piece ends at each safe place."""
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def _chunk(self, raw: bytes) -> tuple:
        """(text before the first safe place, ids between first and last, text after, ids of all, has a safe place, memory)."""
        key = xxhash.xxh3_128_digest(raw)
        got = self.chunks.get(key)
        if got is not None:
            self.chunks.move_to_end(key)
            self.reused += 1
            return got
        self.encoded += 1
        text = raw.decode()
        first = _SAFE.search(text)
        if first is None:
            got = (text, b"", "", self._encode(text), False)
        else:
            a, b = first.start(), len(text)
            while not (text[b - 1] not in _WHITE and b < len(text) and text[b] in _WHITE):
                b -= 1
            head, mid, tail = text[:a], text[a:b], text[b:]
            middle = self._encode(mid) if mid else b""
            got = (head, middle, tail, (self._encode(head), middle, self._encode(tail)), True)
        self.chunks[key] = got = (*got, 4 * len(raw) + 300)  # about its memory
        self.used += got[-1]
        while self.used > self.memory and len(self.chunks) > 1:
            _, old = self.chunks.popitem(last=False)
            self.used -= old[-1]
        return got

    def _plain(self, text: str) -> bytes:
        raw, out, lo, pending = text.encode(), [], 0, ""
        cuts = cut_points(raw, self.bits)
        if len(cuts) == 1:
            whole = self._chunk(raw)[3]
            return b"".join(whole) if isinstance(whole, tuple) else whole
        for hi in cuts:
            head, middle, tail, _, safe, _ = self._chunk(raw[lo:hi])
            lo = hi
            if safe:
                out.append(self._encode(pending + head))
                out.append(middle)
                pending = tail
            else:
                pending += head
        out.append(self._encode(pending))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers; none for NULL or an empty text."""
        if not text:
            return b""
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = []
        for part in self.split.split(text):
            if part in self.special:
                parts.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                parts.append(self._plain(part))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_WHITE = {chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c))}
_ENCODERS: dict = {}


def encoder_of(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", with_values: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row; ``ids`` (binary) and ``decoded`` if asked.

    One row out for each row in, in place: no shuffle, and other columns are ignored. A NULL text counts as
    empty. Chunks are encoded once for each worker process while they stay among its last ``CHUNK_MEMORY``
    bytes; the ids never depend on what is remembered.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary()), ("decoded", pa.string())] * with_values)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(tokenizer)
        for batch in batches(rows):
            ids = [coder.encode(t) for t in batch.column(1).to_pylist()]
            texts = [coder.decode(i) for i in ids]
            out = [batch.column(0), [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(t.encode()).hexdigest() for t in texts]]
            out += [ids, texts] * with_values
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t.type) for v, t in zip(out, schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_values
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)

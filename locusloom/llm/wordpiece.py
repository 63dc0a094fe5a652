"""Word-piece counts by a linear longest-match automaton: lengths only, no pieces are built.

The vocabulary is a trie over bytes with failure links that skip what greedy longest match would emit.
For each node, ``popped`` holds how many pieces are emitted when its failure link is followed (or its
text is completed), so a word costs one step per byte plus one per link.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, byte_stand_ins, words


class PieceCounter:
    """Greedy longest-match piece counts of words.

    ``first`` are the pieces a word may begin with, ``rest`` those it may go on with. A word that can't be
    cut whole counts as one unknown piece, as usual for word pieces.
    """

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes], longest_word: int | None = None):
        self.longest_word = longest_word
        self.step: list[dict[int, int]] = [{}, {}]  # node 0: begin of a word, node 1: begin of a later piece
        piece = [False, False]
        for root, vocabulary in ((0, first), (1, rest)):
            for token in vocabulary:
                at = root
                for byte in token:
                    nxt = self.step[at].get(byte)
                    if nxt is None:
                        nxt = self.step[at][byte] = len(self.step)
                        self.step.append({})
                        piece.append(False)
                    at = nxt
                if token:
                    piece[at] = True
        self.fail, self.popped = [-1] * len(self.step), [0] * len(self.step)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for byte, v in self.step[u].items():
                if piece[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    # go back from u until the byte fits; what is left behind is emitted
                    z, count = self.fail[u], self.popped[u]
                    while z >= 0 and byte not in self.step[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.step[z][byte], count
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if it can't be cut (or is longer than ``longest_word`` bytes), 0 if it is empty."""
        if not word:
            return 0
        if self.longest_word is not None and len(word) > self.longest_word:
            return 1
        step, fail, popped = self.step, self.fail, self.popped
        u, n = 0, 0
        for byte in word:
            while (v := step[u].get(byte)) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = v
        while u > 1:  # at the end, all that is held must fall into whole pieces
            n += popped[u]
            u = fail[u]
        return n if u == 1 else 1


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """First and later pieces from a byte-level vocabulary: those that begin with a space, and those without."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    back = byte_stand_ins()
    raw = [bytes(back[c] for c in token) for token in vocabulary]
    return [t for t in raw if t.startswith(b" ")], [t for t in raw if not t.startswith(b" ")]


_COUNTERS: dict = {}


def _counts_of(path: str) -> Memo:
    if path not in _COUNTERS:
        counter = PieceCounter(*byte_level_pieces(path))
        _COUNTERS[path] = Memo(lambda word: counter.count(b" " + word), limit=1_000_000)
    return _COUNTERS[path]


def piece_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_pieces, longest_word_pieces`` for each row of ``docs``.

    Words are runs of bytes other than ASCII white space; each is cut greedily into the longest pieces, the
    first with the vocabulary's leading space. NULL and empty texts have no words and no pieces. Row by row,
    without a shuffle; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_pieces", pa.int64()), ("longest_word_pieces", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _counts_of(vocabulary).__getitem__
        for batch in batches(rows):
            found = [np.fromiter(map(look, w), dtype=np.int64, count=len(w)) for w in map(words, batch.column(1).to_pylist())]
            out = [batch.column(0), [len(c) for c in found], [int(c.sum()) for c in found], [int(c.max()) if len(c) else 0 for c in found]]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=pa.int64()) for v in out], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_pieces long, longest_word_pieces long"
    )

"""Language-model scores by prediction by partial matching over bytes.

Tokens are words of lower-cased text; a text is spelled as its words, each closed by a space, and an end sign. A
byte is predicted from up to ``ORDER`` bytes before it: the first ``HEAD`` bytes of a word from the last ``HEAD``
bytes of the word before and what follows them, later ones from their own word. Where a context has not seen the
byte, the model escapes to the context without its oldest byte; bytes that the longer context has seen are
excluded there. Escapes are estimated by method D: ``q / 2n`` with ``q`` kinds among ``n`` bytes, half a count
taken from each kind.

The model is trained once and then fixed. So a word's later bytes always cost the same, and its first ones depend
on a pair of short strings: texts are scored by word and by pair, each computed once for many. All contexts count.
Those that make up at least ``2 ** -CONTEXT_BITS`` of all training bytes are broadcast. Contexts of one length are
disjoint, so there are at most ``2 ** CONTEXT_BITS`` of each length, whatever the corpus. Words and pairs that need
rarer ones are spelled once more, each only once. Their bytes and the counts of the corpus are dealt out by the shortest
end of the context that isn't broadcast: all longer contexts with that end, hence all escapes down to what is broadcast, lie
in one group, and no group has a larger share of the training bytes than a broadcast context must have. The same holds for
the words whose counts are broadcast for the base score (``WORD_BITS``); counts of all other words are joined by a
shuffle, none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Laid, batches, signed, span_hashes, written

ORDER = 6
HEAD = 3  # ORDER is twice HEAD
CONTEXT_BITS = 20
WORD_BITS = 20
FLUSH = 100_000  # words a task counts before it passes them on
ROWS = 1 << 18  # counts and questions that a task takes at once
END = b"\n"  # can't occur in a word
_END_HASH = span_hashes(np.frombuffer(END, dtype=np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes of each word and its closing space from the fourth on: context length, context, byte, word's number."""
    stream = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    n = len(stream) - 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(n) - (np.cumsum(sizes) - sizes)[owner]
    late = np.flatnonzero(place >= HEAD)
    length = np.minimum(ORDER, place[late] + 1)
    context = np.zeros(len(late), dtype=U64)
    for back in range(ORDER):
        context |= np.where(length > back, stream[np.maximum(late - back, 0)], 0).astype(U64) << U64(8 * back)
    return length, context, stream[late + 1], owner[late]


def word_ends(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, as small integers: its last ``HEAD`` bytes (spaces before a shorter one), and its first bytes.

    The latter hold up to ``HEAD`` bytes of the word and its closing space, and how many they are above them.
    """
    stream = np.frombuffer(b" " * HEAD + b" ".join(words) + b" " * HEAD, dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = HEAD - 1 + np.cumsum(size + 1)
    start = end - size
    last = first = np.zeros(len(words), dtype=U64)
    for j in range(HEAD):
        last = last | np.where(size > j, stream[end - 1 - j], 0x20).astype(U64) << U64(8 * j)
        first = first | np.where(size >= j, stream[start + j], 0).astype(U64) << U64(8 * j)
    return last, first | np.minimum(size + 1, HEAD).astype(U64) << U64(24)


def pair_key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (last << U64(26)) | first


def pair_contexts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the first bytes of words after others (``pair_key``): context length, context, byte, pair's number."""
    last, count, head = pairs >> U64(26), (pairs >> U64(24)) & U64(3), pairs & U64((1 << 24) - 1)
    context, out = (last << U64(8)) | U64(0x20), []
    for j in range(HEAD):
        byte = (head >> U64(8 * j)) & U64(255)
        own = np.flatnonzero(count > j)
        out.append((np.full(len(own), HEAD + 1 + j), context[own], byte[own].astype(np.uint8), own))
        context = ((context << U64(8)) | byte) & U64((1 << 48) - 1)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def key_of(length: np.ndarray, context: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return (np.asarray(length).astype(U64) << U64(56)) | (context << U64(8)) | np.asarray(byte).astype(U64)


def parts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context length, context and byte of keys made by ``key_of``."""
    return (keys >> U64(56)).astype(np.int64), (keys >> U64(8)) & U64((1 << 48) - 1), (keys & U64(255)).astype(np.uint8)


def ending(context: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """The last ``k`` bytes of each context."""
    return context & ((U64(1) << (U64(8) * np.asarray(k).astype(U64))) - U64(1))


def shortened(keys: np.ndarray, counts: np.ndarray, least: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the same bytes in all ends of their contexts of ``least`` bytes or more, and the sums of their counts."""
    length, context, byte = parts_of(keys)
    found, times = [], []
    for k in range(ORDER + 1):
        own = (length >= k) & (least <= k)
        found.append(key_of(np.full(own.sum(), k), ending(context[own], k), byte[own]))
        times.append(counts[own])
    found, where = np.unique(np.concatenate(found), return_inverse=True)
    return found, np.bincount(where, np.concatenate(times), len(found)).astype(np.int64)


class Trie:
    """Log probabilities of bytes seen in some contexts, and what an escape from each context costs.

    With a context all shorter ones that end it are there too, or in ``below``, the trie that continues this one downwards.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: Trie | None = None):
        self.below = below
        keys = keys.astype(U64)
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[order].astype(np.float64)
        self.log_p = np.zeros(len(keys))
        self.contexts, first = np.unique(self.keys >> U64(8), return_index=True)
        self.log_escape = np.zeros(len(self.contexts))
        if not len(keys):
            return
        total, kinds = np.add.reduceat(counts, first), np.diff(np.append(first, len(keys))).astype(np.float64)
        owner = np.repeat(np.arange(len(first)), kinds.astype(int))
        self.log_p = np.log10((counts - 0.5) / total[owner])
        escape = kinds / (2 * total)
        length = (self.contexts >> U64(48)).astype(np.int64)
        for k in range(ORDER + 1):  # shorter contexts first: an escape is measured by what they leave
            own = np.flatnonzero(length == k)
            if not len(own):
                continue
            rows = np.flatnonzero(length[owner] == k)
            seen = self.keys[rows]
            taken = np.bincount(owner[rows], 10 ** self._shorter(k, seen), len(first))[own]
            left = 1 - taken
            open_ = left > 1e-9
            self.log_escape[own] = np.log10(np.where(open_, escape[own] / np.where(open_, left, 1), 1e-300))
            full = own[~open_]  # all bytes seen: nothing escapes
            at = rows[np.isin(owner[rows], full)]
            self.log_p[at] = np.log10(counts[at] / total[owner[at]])

    def _shorter(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Log probability of the bytes of ``keys`` in the next shorter context."""
        if k == 0:
            return np.full(len(keys), -np.log10(256))
        context = (keys >> U64(8)) & ((U64(1) << U64(8 * (k - 1))) - U64(1))
        return self.log_bytes(np.full(len(keys), k - 1), context, (keys & U64(255)).astype(np.uint8))

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
        return at, (table[at] == wanted) if len(table) else np.zeros(len(wanted), dtype=bool)

    def log_bytes(self, length: np.ndarray, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Log10 probability of each byte in its context, escapes included."""
        out, rest = np.zeros(len(context)), np.arange(len(context))
        for k in range(ORDER, -1, -1):
            fits = length[rest] >= k
            own = rest[fits]
            part = context[own] & ((U64(1) << U64(8 * k)) - U64(1))
            at, found = self._find(self.keys, key_of(np.full(len(own), k), part, byte[own]))
            out[own[found]] += self.log_p[at[found]]
            lost = own[~found]
            at, known = self._find(self.contexts, (U64(k) << U64(48)) | part[~found])
            out[lost[known]] += self.log_escape[at[known]]
            rest = np.concatenate([rest[~fits], lost])
        out[rest] += -np.log10(256) if self.below is None else self.below.log_bytes(length[rest], context[rest], byte[rest])
        return out

    def holds(self, length: np.ndarray, context: np.ndarray) -> np.ndarray:
        """True for bytes whose whole context is here; without any context for all, as nothing was learned."""
        if not len(self.contexts):
            return np.ones(len(context), dtype=bool)
        return self._find(self.contexts, (np.asarray(length).astype(U64) << U64(48)) | context)[1]

    def level(self, length: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Length of the longest end of each context that is here."""
        out, rest = np.zeros(len(context), dtype=np.int64), np.arange(len(context))
        for k in range(1, ORDER + 1):
            rest = rest[length[rest] >= k]
            rest = rest[self.holds(np.full(len(rest), k), ending(context[rest], k))]
            out[rest] = k
        return out

    def _sums(self, found: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over bytes whose context is here, and what has others besides."""
        length, context, byte, owner = found
        here, rest = self.holds(length, context), np.zeros(n, dtype=bool)
        rest[owner[~here]] = True
        if not here.any():
            return np.zeros(n), rest
        return np.bincount(owner[here], self.log_bytes(length[here], context[here], byte[here]), n), rest

    def part_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of the later bytes of each word whose context is here; True for words that have others."""
        return self._sums(contexts(words), len(words)) if words else (np.zeros(0), np.zeros(0, dtype=bool))

    def part_of_pairs(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of a word's first bytes after the word before."""
        return self._sums(pair_contexts(pairs), len(pairs))

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of the later bytes of each word, if all contexts are here."""
        found = contexts(words) if words else (np.zeros(0, np.int64),) * 4
        return np.bincount(found[3], self.log_bytes(*found[:3]), len(words)) if len(found[3]) else np.zeros(len(words))

    def log_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Log10 probability of a word's first bytes after the word before, if all contexts are here."""
        length, context, byte, owner = pair_contexts(pairs)
        return np.bincount(owner, self.log_bytes(length, context, byte), len(pairs)) if len(owner) else np.zeros(len(pairs))


def held_out(doc_id: Column) -> Column:
    """True for ids whose CRC-32 (as text) is 2 modulo 7; false for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class WordTable:
    """Numbers for words, told apart by their hashes, and what is known of each in arrays; begun anew when it holds ``FLUSH`` words."""

    def __init__(self, columns):
        self.columns = columns  # of a list of words and their hashes: a tuple of arrays
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = []
        self.hashes, self.number = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)  # hashes in order, and their words' numbers
        self.known = tuple(self.columns([], self.hashes))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in a row, the end sign before the first and after each text; how many words each has."""
        laid = Laid(texts)
        size, n = np.diff(laid.begins), len(laid.h)
        kinds, first, where = np.unique(np.append(laid.h, _END_HASH), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, kinds), max(len(self.hashes) - 1, 0))
        old = self.hashes[at] == kinds if len(self.hashes) else np.zeros(len(kinds), dtype=bool)
        number = np.zeros(len(kinds), dtype=np.int64)
        number[old] = self.number[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            number[new] = len(self.words) + np.arange(len(new))
            spans = [(int(laid.starts[i]), int(laid.ends[i])) if i < n else None for i in first[new].tolist()]
            words = [END if s is None else laid.low[s[0] : s[1]] for s in spans]
            self.words += words
            self.known = tuple(np.append(a, b) for a, b in zip(self.known, self.columns(words, kinds[new]), strict=True))
            hashes, numbers = np.append(self.hashes, kinds[new]), np.append(self.number, number[new])
            order = np.argsort(hashes)
            self.hashes, self.number = hashes[order], numbers[order]
        ids = number[where]
        out = np.full(n + len(texts) + 1, ids[n])
        out[np.arange(n) + np.repeat(np.arange(len(texts)), size) + 1] = ids[:n]
        return out, size


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``kind, key, n`` over texts ``(text)``: counts of word hashes (0), of context and byte (1), and of texts (2).

    The end sign is not among the words of kind 0 but is spelled like one in kind 1.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def keyed(found: tuple[np.ndarray, ...], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, context, byte, owner = found
        keys, where = np.unique(key_of(length, context, byte), return_inverse=True)
        return keys, np.bincount(where, times[owner], len(keys)).astype(np.int64)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count, heads, seen = WordTable(lambda words, h: (*word_ends(words), h)), np.zeros(0, np.int64), [], 0

        def passed_on() -> pa.RecordBatch:
            found, hashes = table.words, table.known[2]
            own = hashes != _END_HASH[0]
            keys, n = map(np.concatenate, zip(*heads, keyed(contexts(found), count), strict=True))
            keys, where = np.unique(keys, return_inverse=True)
            out = [(np.zeros(own.sum(), np.int32), signed(hashes)[own], count[own])]
            out.append((np.ones(len(keys), np.int32), signed(keys), np.bincount(where, n, len(keys)).astype(np.int64)))
            out.append((np.full(1, 2, np.int32), np.zeros(1, np.int64), np.full(1, seen)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), t.type) for i, t in enumerate(schema)], schema=schema)

        for batch in batches(rows):
            ids, _ = table.numbers(batch.column(0).to_pylist())
            last, first, _ = table.known
            count = np.append(count, np.zeros(len(last) - len(count), np.int64)) + np.bincount(ids[1:], minlength=len(last))
            pairs, times = np.unique(pair_key(last[ids[:-1]], first[ids[1:]]), return_counts=True)
            heads.append(keyed(pair_contexts(pairs), times))
            seen += batch.num_rows
            if len(count) >= FLUSH or sum(len(h[0]) for h in heads) > 4 * FLUSH:
                yield passed_on()
                table.clear()
                count, heads, seen = count[:0], [], 0
        if seen:
            yield passed_on()

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gathered(rows: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[pa.Table]:
    """The rows in tables of about ``most``."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def trained_trie(longest: DataFrame) -> Trie:
    """The trie of the frequent contexts, from counts ``key, n`` of bytes in their longest contexts."""
    size = longest.agg(F.sum("n")).first()[0]
    if not size:
        return Trie(np.zeros(0, U64), np.zeros(0, np.int64))

    def totals(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(rows):
            keys, n = shortened(some["key"].to_numpy().view(U64), some["n"].to_numpy())
            context, first = np.unique(keys >> U64(8), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(context)), pa.array(np.add.reduceat(n, first))], names=["context", "n"])

    often = longest.mapInArrow(totals, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    often = often.filter(F.col("n") * float(1 << CONTEXT_BITS) >= F.lit(size)).select("context").toArrow()  # bounded, see above
    kept = longest.sparkSession.sparkContext.broadcast(np.sort(often["context"].to_numpy().view(U64)))

    def within(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(rows):
            keys, n = shortened(some["key"].to_numpy().view(U64), some["n"].to_numpy())
            context = keys >> U64(8)
            at = np.minimum(np.searchsorted(kept.value, context), len(kept.value) - 1)
            own = kept.value[at] == context
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[own])), pa.array(n[own])], names=["key", "n"])

    rows = longest.mapInArrow(within, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 256 for each of these
    return Trie(rows["key"].to_numpy().view(U64), rows["n"].to_numpy())


_DEALT = pa.schema([("group", pa.int64()), ("asks", pa.bool_()), ("unit", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def _dealt(trie: Trie, keys: np.ndarray, units: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    """Rows of those keys whose context isn't in the trie, with the group they belong to: counts, or what units ask for."""
    length, context, _ = parts_of(keys)
    level = trie.level(length, context)
    away = np.flatnonzero(level < length)
    up = level[away] + 1
    none = np.zeros(len(away), np.int64)
    group = (up.astype(U64) << U64(48)) | ending(context[away], up)
    cols = [signed(group), np.full(len(away), units is not None), none if units is None else units[away], signed(keys[away]), none if n is None else n[away]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_DEALT)


def unit_scores(units: DataFrame, longest: DataFrame, model: Broadcast) -> DataFrame:
    """``id, part``: log10 probability of those bytes of each unit ``(id, unit)`` whose context the trie doesn't hold.

    A unit is a word, or a space and the number of a pair. ``longest`` holds the counts of bytes in their longest contexts,
    ``model`` is a tuple that begins with the trie.
    """
    most = ROWS

    def spelt(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = model.value[0]
        for batch in batches(rows, 1 << 20):
            ids, found = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            is_pair = np.array([u[:1] == b" " for u in found])
            words = [u for u in found if u[:1] != b" "]
            pairs = np.array([int.from_bytes(u[1:], "big") for u in found if u[:1] == b" "], dtype=U64)
            for of, parts in ((ids[~is_pair], contexts(words) if words else None), (ids[is_pair], pair_contexts(pairs) if len(pairs) else None)):
                if parts is not None:
                    length, context, byte, owner = parts
                    yield _dealt(trie, key_of(length, context, byte), of[owner], None)

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(rows):
            yield _dealt(model.value[0], some["key"].to_numpy().view(U64), None, some["n"].to_numpy())

    def graded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups one after the other, the counts of each before what is asked; counts of an unfinished group are kept."""
        trie = model.value[0]
        groups, keys, n = np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
        for some in gathered(rows, most):
            asks, group, key = (some[c].to_numpy() for c in ("asks", "group", "key"))
            groups = np.append(groups, group[~asks])
            keys, n = np.append(keys, key[~asks].view(U64)), np.append(n, some["n"].to_numpy()[~asks])
            if asks.any():
                own = np.isin(groups, group[asks])
                local = Trie(*shortened(keys[own], n[own], groups[own] >> 48), below=trie)
                unit, where = np.unique(some["unit"].to_numpy()[asks], return_inverse=True)
                part = np.bincount(where, local.log_bytes(*parts_of(key[asks].view(U64))), len(unit))
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(part)], names=["id", "part"])
            last = groups == group[-1]
            groups, keys, n = groups[last], keys[last], n[last]

    ddl = "group long, asks boolean, unit long, key long, n long"
    dealt = longest.mapInArrow(counted, ddl).unionByName(units.select("id", "unit").mapInArrow(spelt, ddl))
    ordered = dealt.repartition("group").sortWithinPartitions("group", "asks")
    return ordered.mapInArrow(graded, "id long, part double").groupBy("id").agg(F.sum("part").alias("part"))


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows that aren't held out (by id), scores all. NULL and empty texts are the end sign alone. ``score``
    is the model's log10 probability of the text, ``base_score`` that of its tokens by smoothed counts. Without any
    training row the model is uniform over bytes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    counts = written(corpus_counts(texts.filter(~F.col("held_out")).select("text")), "counts")
    sums = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    n_of, kinds_of = {r.kind: r.n for r in sums}, {r.kind: r.kinds for r in sums}
    ends = n_of.get(2, 0)
    tokens, distinct = n_of.get(0, 0) + ends, kinds_of.get(0, 0) + (ends > 0)
    size = tokens + distinct + 1
    longest = counts.filter("kind = 1").select("key", "n")
    trie = trained_trie(longest)

    # frequent words: at most 2 ** WORD_BITS reach the share, so they may be broadcast
    often = F.col("n") * float(1 << WORD_BITS) >= F.lit(tokens)
    frequent = counts.filter("kind = 0").filter(often).select("key", "n").orderBy("key").toArrow()
    shared = spark.sparkContext.broadcast((trie, frequent["key"].to_numpy(), frequent["n"].to_numpy()))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        + [("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("units", pa.list_(pa.binary())), ("unit_times", pa.list_(pa.int32()))]
    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, n = shared.value
        log_n = np.log10((n + 1) / size)
        base_end = float(np.log10((ends + 1) / size))

        def columns(new: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, ...]:
            h = signed(hashes)
            base = np.full(len(new), np.nan)
            if len(keys) and len(new):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                base = np.where(keys[at] == h, log_n[at], np.nan)
            names = np.empty(len(new), dtype=object)
            names[:] = new
            return *word_ends(new), h, base, *model.part_of_words(new), names

        table = WordTable(columns)
        for batch in batches(rows):
            if len(table.words) >= FLUSH:
                table.clear()
            ids, sizes = table.numbers(batch.column(1).to_pylist())
            last, first, hashes, log_base, log_word, more_word, names = table.known
            pairs, where = np.unique(pair_key(last[ids[:-1]], first[ids[1:]]), return_inverse=True)
            log_pair, more_pair = model.part_of_pairs(pairs)
            log_p = log_pair[where] + log_word[ids[1:]]
            out, lo = [[], [], [], [], [], [], [], []], 0
            for own in sizes.tolist():
                hi = lo + own
                of_words = ids[lo + 1 : hi + 1]
                base = log_base[of_words]
                unknown = np.isnan(base)
                rare, times = np.unique(hashes[of_words[unknown]], return_counts=True)
                score = float(log_p[lo : hi + 1].sum())
                of_pairs = where[lo : hi + 1]
                seldom_words, word_times = np.unique(of_words[more_word[of_words]], return_counts=True)
                seldom_pairs, pair_times = np.unique(of_pairs[more_pair[of_pairs]], return_counts=True)
                units = names[seldom_words].tolist() + [b" " + p.to_bytes(7, "big") for p in pairs[seldom_pairs].tolist()]
                lo = hi + 1
                row = (own + 1, own - int(unknown.sum()) + (ends > 0), float(np.nansum(base)) + base_end, score, rare, times.astype(np.int32), units, np.append(word_times, pair_times).astype(np.int32))
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, t.type) for c, t in zip(out, list(schema)[2:], strict=True)]], schema=schema)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>, units array<binary>, unit_times array<int>"
    scored = written(texts.mapInArrow(run, ddl).withColumn("row", F.monotonically_increasing_id()), "scored")
    seldom = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
    of_word = counts.filter("kind = 0").filter(~often).select("key", "n")
    n = F.coalesce("n", F.lit(0))
    added = (
        seldom.join(of_word, "key", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10((n + 1) / F.lit(size))).alias("more_base"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    of_row = scored.select("row", F.explode(F.arrays_zip("units", "unit_times")).alias("u")).select("row", F.xxhash64("u.units").alias("id"), F.col("u.units").alias("unit"), F.col("u.unit_times").alias("times"))
    of_unit = written(unit_scores(of_row.select("id", "unit").distinct(), longest, shared), "units")
    more = of_row.select("row", "id", "times").join(of_unit, "id").groupBy("row").agg(F.sum(F.col("times") * F.col("part")).alias("more"))
    return scored.drop("rare", "times", "units", "unit_times").join(added, "row", "left").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )

"""Ids in planes, BPE with chunk reuse, word-piece counts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locusloom.llm import binary_ids, bpe_chunks, wordpiece

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
word_tokenizer, byte_tokenizer = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
word_encoder, chunk_encoder = binary_ids.WordEncoder(WORD), bpe_chunks.ChunkEncoder(BYTE, bits=4)
TEXTS = st.text(alphabet=st.sampled_from(" \n\t\xa0　\x1c\x85abcdABÉé'!,.1²日Σσİß<|>"), max_size=300)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_word_ids_equal_the_tokenizers(text):
    want = word_tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_encoder(text), "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_chunked_ids_equal_the_tokenizers(text):
    want = byte_tokenizer.encode(text, add_special_tokens=False).ids
    ids = chunk_encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert chunk_encoder.decode(ids) == byte_tokenizer.decode(want, skip_special_tokens=False)


def test_chunks_are_reused_and_cut_by_content():
    rng = random.Random(2)
    shared = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(3_000))
    coder = bpe_chunks.ChunkEncoder(BYTE)
    coder.encode("one begins " + shared)
    made = coder.encoded
    text = "another begins quite differently " + shared + " tail"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == byte_tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.reused >= 0.7 * made
    assert b"".join(b"x" * n for n in np.diff([0, *bpe_chunks.cut_points(b"abc" * 900)])) == b"x" * 2700


def test_forgetting_chunks_changes_nothing():
    coder = bpe_chunks.ChunkEncoder(BYTE, bits=4, memory=2_000)
    text = " ".join(f"word{i % 37} and more" for i in range(2_000))
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == byte_tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.used <= 2_000 or len(coder.chunks) == 1


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 7 else 49_408, n, dtype=np.uint32)
    index, payload = binary_ids.pack_ids(ids, planes, block=64)
    assert [e["n"] for e in index] == [64] * (n // 64) + [n % 64] * (n % 64 > 0)
    assert binary_ids.unpack_ids(payload, index, planes).tolist() == ids.tolist()
    if len(index) > 3:  # one block by its entry alone
        assert binary_ids.unpack_block(payload, index[3], planes).tolist() == ids[192:256].tolist()


def test_unknown_planes():
    with pytest.raises(ValueError):
        binary_ids.to_planes(np.arange(3, dtype=np.uint32), "nibble")


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_store_of_odd_rows(spark, table, odd_rows, planes):
    path = llm_path(spark)
    binary_ids.write_planes(table(odd_rows), path, WORD, planes=planes, block=1000, segment=5000)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in binary_ids.read_planes(spark, path, with_ids=True).collect())
    want, start = [], 0
    for doc, text, _ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(word_tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.append((doc is not None, doc or 0, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    assert got == sorted(want)


def llm_path(spark):
    from locusloom.llm.common import scratch_path

    return scratch_path(spark, "planes")


def test_empty_tables(spark, table, odd_rows):
    none = table(odd_rows).limit(0)
    path = llm_path(spark)
    binary_ids.write_planes(none, path, WORD)
    assert binary_ids.read_planes(spark, path).collect() == []
    assert bpe_chunks.encode_decode(none, BYTE).collect() == []
    assert wordpiece.piece_counts(none, BYTE).collect() == []


def test_encode_decode_of_odd_rows(table, odd_rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = bpe_chunks.encode_decode(table(odd_rows), BYTE, with_values=True).collect()
    want = []
    for doc, text, _ in odd_rows:
        ids = byte_tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(byte_tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)
    assert all(r.decoded == (t or "") for r, (_, t, _) in zip(got, odd_rows, strict=True))


def greedy(word, first, rest, longest=12):
    n = at = 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in (rest if n else first):
                break
        else:
            return 1
        n, at = n + 1, end
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(c % 3 + 97 for c in b)), max_size=8), st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(c % 3 + 97 for c in b)), max_size=8), st.lists(st.binary(max_size=12).map(lambda b: bytes(c % 3 + 97 for c in b)), max_size=20))
def test_automaton_counts_like_greedy_search(first, rest, words):
    counter = wordpiece.PieceCounter(first, rest)
    assert [counter.count(w) for w in words] == [greedy(w, first, rest) for w in words]


def test_piece_counts_of_odd_rows(table, odd_rows):
    first, rest = (set(x) for x in wordpiece.byte_level_pieces(BYTE))
    got = {(r.doc_id, r.n_words, r.n_pieces) for r in wordpiece.piece_counts(table(odd_rows), BYTE).collect()}
    want = set()
    for doc, text, _ in odd_rows:
        w = (text or "").encode().split()
        want.add((doc, len(w), sum(greedy(b" " + x, first, rest, 140) for x in w)))
    assert got == want
    assert wordpiece.PieceCounter([b"a"], [b"a"], longest_word=3).count(b"aaaa") == 1

"""Every stage of the corpus pipeline on its own input, and ``run`` as a whole, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from locusloom.llm import common, fair_mix, isolation  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path, prose):
    """Clean texts, near and exact copies, a pasted passage, and odd rows, with labels of some."""
    rng = random.Random(21)
    texts = prose(70, words=90, seed=5, vocabulary=4_000)
    passage = " ".join(prose(1, words=70, seed=6, vocabulary=4_000)[0].split())
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    for i in range(12):  # one word in ninety differs: far above 0.8
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, texts[20]) for i in range(6)]
    rows += [(400 + i, f"{t} {passage} and {i}") for i, t in enumerate(prose(4, words=60, seed=7, vocabulary=4_000))]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "word"), (5, "#### $$ %% ** && || <> " * 40), (None, "a row without an id"), (10, texts[0])]
    full = [(d, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, (d, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d, int(d != 5), 0) for d, _ in rows if d is not None and d % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages_equal_brute_force(spark, folder):
    docs = common.read(spark, folder, "documents")
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        docs = common.written(stage(spark, docs, folder), name)
        if name != "encoding":
            assert docs.columns == before[name].columns
    got = {n: d.collect() for n, d in before.items()}

    verdicts = {r.doc_id for r in isolation.quality_verdicts(before["quality"], common.read(spark, folder, "labels")).filter("kept").collect()}
    assert sorted(map(str, got["near_dedup"])) == sorted(str(r) for r in got["quality"] if r.doc_id is not None and r.doc_id in verdicts)

    sets = {}
    for r in got["near_dedup"]:
        sets.setdefault(r.doc_id, shingles(r.text))
    ids = sorted(sets)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    assert {r.doc_id for r in got["passage_dedup"]} == {i for i in ids if least[i] == i}

    was = {r.doc_id: r.text for r in got["passage_dedup"]}
    for r in got["mixing"]:
        assert r.n_chars == len(r.text) and len(r.text) <= len(was[r.doc_id])
        rest = iter(was[r.doc_id])
        assert all(c in rest for c in r.text)  # what stays stands in the old order
    passage_words = {r.doc_id: r.text.split() for r in got["mixing"]}
    tails = [d for d in passage_words if d >= 400]
    shared = set.intersection(*[set(was[d].split()) for d in tails]) if len(tails) > 1 else set()
    holders = [d for d in tails if len(shared & set(passage_words[d])) > 50]
    assert holders == tails[:0] or holders == [min(tails)]

    size, taken = {}, Counter()  # two equal rows of one id are mixed as one document taken as often as both
    for r in fair_mix.mix_counts(before["mixing"]).collect():
        size[r.doc_id] = r["size"]
        taken[r.doc_id] += r.taken
    times = Counter(r.doc_id for r in got["encoding"])
    assert all(times[d] * n == taken[d] for d, n in size.items())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in got["encoding"]:
        ids_ = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids_, skip_special_tokens=False)
        want.append((r.doc_id, len(ids_), hashlib.sha256(np.array(ids_, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    final = sorted(tuple(r)[:4] for r in docs.collect())
    assert final == sorted(want)
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, folder).collect()) == final


def test_stages_of_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == []
        if name != "encoding":
            assert out.columns == docs.columns

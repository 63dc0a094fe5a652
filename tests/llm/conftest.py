import random

import pytest

llm = pytest.importorskip("locusloom.llm.common")
tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size long, kept boolean, score double, key long, row long, _part int, start int, place int, n string, run string, component_id string"
)


@pytest.fixture(autouse=True)
def _workers(spark):
    llm.workers_find_package(spark)


@pytest.fixture
def table(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)``, with extra columns of clashing names."""

    def make(rows):
        full = []
        for r in rows:
            doc, text, source = (*r, "s")[:3]
            full.append((doc, text, None, source, len(text or ""), 7, False, 0.5, 1, 2, 3, 4, 5, "x", "y", "z"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """NULL, empty, blank, one-word, non-ASCII, very long and repeated texts, a row without id, ties."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    long_text = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    twin = "The same words stand here twice, in two rows of equal text and in one more row."
    return [
        (0, None, None),
        (1, "", "a"),
        (2, " \n\t ", "a"),
        (3, "word", "b"),
        (4, "Éa ñ 日本語 İß  x y", None),
        (5, long_text, "a"),
        (6, twin, "a"),
        (7, twin, "b"),
        (7, twin, "b"),
        (None, "no id here", "c"),
        (8, "<|endoftext|> text with <|startoftext|> marks", "c"),
        (9, "\x00 zero \x1c separators \x1d\x85 here", "c"),
    ]


@pytest.fixture
def prose():
    def make(n, words=80, seed=1, vocabulary=600):
        rng = random.Random(seed)
        pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
        out = []
        for _ in range(n):
            w = [rng.choice(pool) for _ in range(words)]
            for i in range(7, words, 8):
                w[i] += rng.choice([".", ".\n"])
            out.append(" ".join(w))
        return out

    return make

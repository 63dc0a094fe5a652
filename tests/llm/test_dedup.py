"""Near-duplicate documents, passages and vectors, components; against brute force."""

import random

import numpy as np
import pytest

from locusloom.llm import common, paragraphs, spherical, superminhash
from locusloom.llm.components import components


def group_ids(nodes, links):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {
        "path": [(i, i + 1) for i in rng.sample(range(60), 60)],
        "star": [(100, i) for i in range(50)] + [(7, 7)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "none": [],
    }[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = group_ids({x for p in links for x in p}, links)
    alone = {x for p in links for x in p} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n not in alone}


def test_signature_equals_the_element_wise_definition():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 400):
        elements = rng.integers(0, 2**63, n).astype(np.uint64)
        slots = 20
        want = np.full(slots, np.iinfo(np.uint64).max, dtype=np.uint64)
        for x in elements:  # every rank of every element, no early end
            place, state = list(range(slots)), np.array([x])
            for j in range(slots):
                state = common.mixed(state + np.uint64(0x9E3779B97F4A7C15))
                k = j + int(state[0] % np.uint64(slots - j))
                place[j], place[k] = place[k], place[j]
                value = (np.uint64(j) << np.uint64(52)) | (common.mixed(state ^ np.uint64(0xD6E8FEB86659FD93))[0] >> np.uint64(12))
                want[place[j]] = min(want[place[j]], value)
        assert superminhash.superminhash(elements, slots).tolist() == want.tolist()


def test_estimates_are_near_and_vary_less_than_independent_ones():
    rng, errors = np.random.default_rng(2), []
    for _ in range(300):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = superminhash.superminhash(pool[:45]), superminhash.superminhash(pool[15:])
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.9 * np.sqrt(0.25 / superminhash.SLOTS)


def edited(text, rng, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture
def copies(prose, odd_rows):
    """A large group of edited copies, small groups, exact copies, and odd rows."""
    rng, texts = random.Random(8), prose(40, words=120)
    rows = [(100 + i, edited(texts[0], rng, rng.randrange(9))) for i in range(120)]
    rows += [(300 + i, t) for i, t in enumerate(texts)]
    rows += [(400 + i, edited(texts[i % 20 + 1], rng, i % 4)) for i in range(60)]
    rows += [(500 + i, texts[39].upper()) for i in range(50)]
    return rows + [r[:2] for r in odd_rows]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(table, copies, words, percent):
    sets = {d: shingles(t, words) for d, t in copies if d is not None}
    nodes = sorted(sets)
    links = [(a, b) for i, b in enumerate(nodes) for a in nodes[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = group_ids(nodes, links)
    got = superminhash.near_duplicates(table(copies), words=words, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(d), len(shingles(t, words))) for d, t in copies)
    assert all(r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_large_bands_are_compared_in_blocks(table, copies, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 8)
    want = {str(r.doc_id): r.component_id for r in superminhash.near_duplicates(table(copies), words=3, percent=85).collect()}
    sets = {d: shingles(t, 3) for d, t in copies if d is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {k: v for k, v in want.items() if k != "None"} == {str(k): v for k, v in group_ids(sets, links).items()}


@pytest.mark.parametrize("seed", range(6))
def test_forest_ties_what_links_tie(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 50))) for _ in range(40)]
    ids, parts = rng.permutation(1_000)[:40], rng.integers(0, 12, 40)
    for left in (np.ones(40, dtype=bool), rng.random(40) < 0.5):
        right = left if left.all() else ~left
        links = [(int(ids[x]), int(ids[y])) for x in np.flatnonzero(left) for y in np.flatnonzero(right) if x != y and 100 * len(np.intersect1d(sets[x], sets[y])) >= 60 * len(np.union1d(sets[x], sets[y]))]
        same = [(int(ids[x]), int(ids[y])) for x in range(40) for y in range(x) if parts[x] == parts[y]]
        forest = superminhash.linked_forest(ids, parts, sets, left, 60)
        nodes = [int(i) for i in ids]
        assert group_ids(nodes, same + forest) == group_ids(nodes, same + links)
        assert set(forest) <= {(min(p), max(p)) for p in links} and len(forest) < 40


def test_links_in_blocks_are_linear(spark):
    """200 near copies and 100 unrelated sets in one band give fewer links than members."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 2**63, 3).astype(np.uint64)])) for _ in range(200)] + [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(100)]
    elements = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, elements binary")
    apart = spark.createDataFrame([(k, i, i) for k in (1, 2) for i in range(300)], "key long, id long, part long")
    got = [(r.a, r.b) for r in superminhash.links_in_blocks(apart, elements, 85).collect()]
    assert len(got) == 199 and len(set(group_ids(range(200), got).values())) == 1


def test_no_documents(table, copies):
    none = table(copies).limit(0)
    assert superminhash.near_duplicates(none).collect() == []
    assert paragraphs.repeated_passages(none).collect() == []
    assert paragraphs.without_passages(none, paragraphs.repeated_passages(none)).collect() == []


def test_paragraphs_cover_all_words_and_follow_content(prose):
    host, passage = prose(2, words=200)
    first, end, lo, hi, h = paragraphs.paragraphs(host)
    assert first[0] == 0 and end[-1] == len(h) and (first[1:] == end[:-1]).all()
    assert [host.encode()[a:b].split() for a, b in zip(lo, hi, strict=True)] == [host.encode().split()[a:b] for a, b in zip(first, end, strict=True)]
    prints = set(paragraphs.fingerprints(first, end, h).tolist())
    f2, e2, _, _, h2 = paragraphs.paragraphs("some other " + passage[:40] + " words " + host + " and an end")
    assert len(prints & set(paragraphs.fingerprints(f2, e2, h2).tolist())) >= len(prints) - 3


def test_pasted_passages_go_and_clean_texts_stay(table, prose, odd_rows):
    rng = random.Random(4)
    texts = prose(60, words=150, vocabulary=5_000)
    passages = [" ".join(t.split()[:60]) for t in prose(6, words=70, seed=9, vocabulary=5_000)]
    rows = []
    for i, t in enumerate(texts):
        w = t.split(" ")
        at = rng.randrange(len(w))
        rows.append((i + 20, " ".join(w[:at] + [passages[i % 6]] + w[at:]) if i < 30 else t))
    docs = table(rows + [r[:2] for r in odd_rows])
    found = paragraphs.repeated_passages(docs)
    out = {r.doc_id: r.text for r in paragraphs.without_passages(docs, found).collect() if r.doc_id is not None}
    for k, p in enumerate(passages):
        holders = [d for d, t in out.items() if t and " ".join(p.split()) in " ".join(t.split())]
        assert holders == [20 + k]  # the first document keeps it whole
    assert all(out[d] == t for d, t in rows if d >= 50 or d < 26)
    assert {d: t for d, t in out.items() if d in (0, 1, 2, 3, 4, 5, 6)} == {d: t for d, t, _ in odd_rows if d in (0, 1, 2, 3, 4, 5, 6)}
    for r in found.collect():
        assert r.words >= paragraphs.LEAST_RUN and min(r.kept_in) <= r.doc_id


def test_short_passages_without_marks_go_whole_at_any_place(table):
    """51 words pasted into two texts each, without line or sentence ends."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}é" for _ in range(n)]
    docs, passages = [], []
    for k in range(80):
        passages.append(" ".join(words(51)))
        for d in (2 * k, 2 * k + 1):
            docs.append((d, " ".join([*words(rng.randrange(1, 90)), passages[k], *words(rng.randrange(1, 90))])))
    df, text = table(docs).select("doc_id", "text"), dict(docs)
    at = {2 * k + 1: (text[2 * k + 1].index(p), text[2 * k + 1].index(p) + len(p)) for k, p in enumerate(passages)}
    equal = {}
    for r in paragraphs.equal_pieces(df).collect():
        assert r.kept == r.doc_id - 1
        lo, hi = equal.get(r.doc_id, (r.start, r.end))
        equal[r.doc_id] = (min(lo, r.start), max(hi, r.end))
    assert equal == at
    got = {r.doc_id: r for r in paragraphs.repeated_passages(df).collect()}
    assert set(got) == set(at)
    for d, (start, end) in at.items():  # near paragraphs may reach a little further
        assert got[d].start <= start and got[d].end >= end and 51 <= got[d].words <= 65 and got[d].kept_in == [d - 1]


def test_every_equal_run_of_the_least_length_is_found_and_no_shorter_phrase(table):
    """20 words pasted into two texts each; phrases of 10 words, which the texts share by chance, make no rows."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}é" for _ in range(n)]
    phrases = [words(10) for _ in range(3)]
    own = lambda: [*words(rng.randrange(1, 30)), *rng.choice(phrases), *words(rng.randrange(1, 30))]
    docs, at = [], {}
    for k in range(60):
        run = words(paragraphs.LEAST_RUN)
        for d in (2 * k, 2 * k + 1):
            docs.append((d, " ".join([*own(), *run, *own()])))
        start = docs[-1][1].index(" ".join(run))
        at[2 * k + 1] = (start, start + len(" ".join(run)), 2 * k)
    got = paragraphs.equal_pieces(table(docs).select("doc_id", "text")).collect()
    assert {r.doc_id: (r.start, r.end, r.kept) for r in got} == at and len(got) == len(at)


def test_stretches_of_one_text_leave_what_stays_whole(table):
    """A passage twice in one text, and one word many times."""
    rng = random.Random(22)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(30)
    twice = [*words(7), *passage, *words(7), *passage, *words(7)]
    docs = table([(1, " ".join(twice)), (2, " ".join(["word"] * 60))]).select("doc_id", "text")
    got = {r.doc_id: (r.lo, r.hi, r.kept) for r in paragraphs.equal_pieces(docs).collect()}
    assert got == {1: (44, 74, 1), 2: (paragraphs.WINDOW, 60, 2)}


def test_span_hashes_tell_words_apart():
    text = "a aa aaaaaaaa aaaaaaaaa aaaaaaaaaaaaaaaab aaaaaaaaaaaaaaaac b É日本 A a aaaaaaaaa aaaaaaaaaaaaaaaab " + "x" * 40 + " " + "X" * 40 + " " + "x" * 41
    found = text.encode().lower().split()
    h = paragraphs.Laid([None, text, ""]).h
    assert len(h) == len(found)
    assert all((h[i] == h[j]) == (found[i] == found[j]) for i in range(len(found)) for j in range(len(found)))


def test_pieces_of_periodic_texts():
    for period in range(1, 5):
        h = np.tile(common.mixed(np.arange(1, period + 1, dtype=np.uint64)), 60 // period)
        first, end = paragraphs.pieces(h)
        assert first[0] == 0 and end[-1] == len(h) and (first[1:] == end[:-1]).all()
        assert len(first) >= 6


def test_near_paragraphs_are_found(table, prose):
    base = prose(1, words=400, vocabulary=5_000)[0]
    w = base.split(" ")
    changed = " ".join("altered" if i % 90 == 40 else x for i, x in enumerate(w))
    docs = table([(1, base), (2, changed)])
    gone = sum(r.words for r in paragraphs.repeated_passages(docs).collect() if r.doc_id == 2)
    assert gone >= 300


def test_rows_of_one_id_with_equal_text_are_one_document(table, prose):
    text = prose(1, words=100)[0]
    docs = table([(1, text), (1, text)])
    assert paragraphs.repeated_passages(docs).collect() == []


def brute_vectors(rows, cosine=0.95):
    good = {i: np.array(v, dtype=float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= cosine]
    ids = group_ids([i for i, _ in rows], links)
    n = {i: sum(i in p for p in links) for i, _ in rows}
    return {(i, n[i], ids[i], ids[i] == i) for i, _ in rows}


@pytest.mark.parametrize("dense", [10, 50_000])
def test_vectors_equal_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(spherical, "DENSE", dense)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 6))
    points = (centres[rng.integers(0, 10, 300)] + 0.25 * rng.normal(size=(300, 6))).astype(np.float32)
    points[100:140] = points[99]
    points[141] = points[140] * 8
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(900, None), (901, []), (902, [0.0] * 6), (903, [float("nan")] * 6), (904, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (905, [float("inf")] + [0.0] * 5), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [-1.0, -2.0]), (909, [1e-30] * 6), (910, [1e30] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, cell int, id int")
    got = {tuple(r) for r in spherical.near_duplicate_vectors(df, cell=40, block=16).collect()}
    assert got == brute_vectors(rows)
    assert spherical.near_duplicate_vectors(df.limit(0)).collect() == []


def test_vectors_without_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, spherical.near_duplicate_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)], key=str)


def test_kmeans_separates_clusters():
    rng = np.random.default_rng(0)
    points = spherical.unit(np.concatenate([np.eye(4)[i] + 0.05 * rng.normal(size=(50, 4)) for i in range(4)]))
    centres = spherical.spherical_kmeans(points, 4)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)
    assert len(spherical.spherical_kmeans(points[:2], 4)) == 2


def test_paragraph_clusters_in_blocks_equal_brute_force(spark, table, monkeypatch):
    """Bands that stay apart are compared in small blocks."""
    for name, value in (("BLOCK", 4),):
        monkeypatch.setattr(superminhash, name, value)
    rng = np.random.default_rng(5)
    stem = [f"s{i}" for i in range(20)]
    docs = []
    for _ in range(25):
        own = stem + [f"w{i}" for i in rng.integers(0, 10**6, 10)]
        docs += [" ".join(own), " ".join([*own[:-1], f"w{rng.integers(0, 10**6)}"])]
    df = table(list(enumerate(docs))).select("doc_id", "text")
    sets = {}
    for text in docs:
        first, end, _, _, h = paragraphs.paragraphs(text)
        prints = paragraphs.fingerprints(first, end, h).view(np.int64)
        for p, a, b in zip(prints.tolist(), first, end, strict=True):
            if b - a >= paragraphs.NEAR:
                sets[p] = set(paragraphs.window_hashes(h[a:b], 5).tolist())
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links
    ids = group_ids(list(sets), links)
    got = {r["node"]: r["component"] for r in paragraphs.near_clusters(df, paragraphs.paragraph_table(df)).collect()}
    assert got == {p: ids[p] for p in {x for pair in links for x in pair}}

"""Fill-in-middle, licence scan and filter audit; against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusloom.llm import fill_middle, filter_audit, license_rules, license_scan

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
RULES = license_rules.all_rules()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\x0b\x1c\x85\xa0abÉ日😀\x00"), max_size=30), min_size=1, max_size=6))
def test_units_of_a_batch(texts):
    units, parents, n = fill_middle.unit_lists(pa.array(texts, type=pa.string()))
    want = [UNIT.findall(t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert units.to_pylist() == [u for w in want for u in w]
    assert parents.tolist() == [i for i, w in enumerate(want) for _ in w]


def middle_moved(doc_id, text, percent=50, spm=80):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return (doc_id, n, "plain", None, None, text)
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_fill_in_middle(table, odd_rows, prose):
    extra = ["ends in white space \n", "<", "a < b <P b", "has <M> a mark", "😀 and 日本", "   ", "P>x<S"]
    rows = [*odd_rows, *[(100 + i, t, "s") for i, t in enumerate([*extra * 8, *prose(40)])]]
    for options in ({}, {"percent": 100, "spm_percent": 50}):
        want = sorted((middle_moved(r[0], r[1] or "", *(options and (100, 50) or (50, 80))) for r in rows), key=str)
        out = fill_middle.fill_in_middle(table(rows), **options)
        assert sorted((tuple(r) for r in out.collect()), key=str) == want
        back = out.select("doc_id", "form", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
        assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
        assert {r.form for r in back} == {"plain", "psm", "spm"}
    digests = fill_middle.fill_in_middle_digests(table(rows))
    assert digests.filter("output_sha256 = restored_sha256 AND form <> 'plain'").isEmpty()
    assert fill_middle.fill_in_middle(table([])).collect() == []


def norm_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def scanned(text, rules=RULES):
    words = norm_words(text)
    norm = " " + " ".join(words) + " "
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    spans = []
    for number, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            spans.append((norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" ") - 1, r.tier, number))
    held = lambda s: any(o != s and o[0] <= s[0] and o[1] >= s[1] and o[2] <= s[2] and (o[:3] != s[:3] or o[3] < s[3]) for o in spans)
    kept = [s for s in spans if not held(s)]
    base = {label for _, label in places}
    score = max([license_scan.CONFIDENCE[s[2] - 1] for s in kept] + [0.6 if places else 0.0])
    return (
        len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
        ",".join(sorted(base)), ",".join(sorted(base | {rules[s[3]].label for s in kept})), score, len(kept),
    )


NOTICES = [
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.",
    "CC-BY cc by cc BY-SA 3.0, cc by",
    "© Copyright (c) 2019 Some Company & Sons Ltd. ALL RIGHTS RESERVED. all rights reserved all rights reserved",
    "GNU Lesser General Public License v2.1 or (at your option) any later version; see the license for details",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "SPDX-License-Identifier: GPL-2.0-only",
    "Creative Commons Attribution-ShareAlike 4.0 International License",
    "aCC BY. ccby, cc\nby; généralpublic license general public licenses",
    "Kind All Rİghts reserved ALL RIGHTS RESERVED",
    "three-clause BSD license, BSD 3-Clause, Mozilla Public License 2.0",
]


def test_license_scan(table, odd_rows, prose):
    rng, filler = random.Random(4), prose(25)
    rows = [*odd_rows, *[(200 + i, t, "s") for i, t in enumerate(NOTICES)]]
    for i in range(40):
        parts = [rng.choice(filler)[:300] for _ in range(3)] + rng.choices(NOTICES, k=3)
        rng.shuffle(parts)
        rows.append((300 + i, rng.choice([" ", "\n", ""]).join(parts), "s"))
    rows.append((400, " ".join(NOTICES * 150), "s"))
    got = sorted((tuple(r) for r in license_scan.license_scan(table(rows)).collect()), key=str)
    small = [r for r in rows if r[0] != 400]
    assert [g for g in got if g[0] != 400] == sorted(((r[0], *scanned(r[1])) for r in small), key=str)
    (many,) = [g for g in got if g[0] == 400]
    one = scanned(" ".join(NOTICES))
    assert many[1] == 150 * one[0] and many[2] == 150 * one[1] and many[6] == one[5]
    spans = license_scan.license_detections(table(rows[-20:-10])).collect()
    assert spans and all(s.start <= s.end for s in spans) and {s.kept for s in spans} == {True, False}
    assert license_scan.license_scan(table([])).collect() == []


def test_keywords_hold_for_every_match():
    """Shortest and longest forms of each pattern hold the rule's keyword as a word, and match."""
    assert len(RULES) > 300 and len({r.pattern for r in RULES}) == len(RULES)
    for r in RULES:
        for pick in (0, -1):
            form = r.pattern
            while (m := re.search(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\})?", form)) is not None:
                choice = m[1].split("|")[pick]
                form = form[: m.start()] + ("" if m[2] and m[2] != "{1,12}" and pick == 0 else choice.replace(r"\S+", "x")) + form[m.end() :]
            form = re.sub(r"\[(.)[^]]*\](\{\d\})?", lambda m: m[1] * int((m[2] or "{1}")[1]), form).replace(r"\S+", "x").replace(" ?", "" if pick == 0 else " ")
            form = re.sub(r"(\w)\?", r"\1", form)
            assert re.fullmatch(r.pattern, form), (r, form)
            assert r.keyword in form.split(" "), (r, form)


def test_license_scan_is_native(table):
    plan = license_scan.license_scan(table([(1, "MIT license", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|MapInArrow|Pandas", plan)


def audited(rows, labels):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    masks = []
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": doc_id is not None and first[t] < doc_id}
        masks.append((source or "", {f for f in fails if fails[f]}, labels.get(doc_id, (0, 0))))
    out = []
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        shapley, found = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                redundant = sum(f in m[0] for m in own) - len(gone)
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                found.append((part, order, step, len(left), len(gone), redundant, sum(m[0] == {f} for m in own), sum(m[1][0] for m in gone), sum(m[1][1] for m in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def test_filter_audit(spark, table, odd_rows, prose):
    rng = random.Random(8)
    texts = [" ".join(prose(4, words=rng.choice([20, 80]), seed=i)) for i in range(30)]
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in odd_rows]
    for i in range(300):
        t = rng.choice(texts)
        t = t.upper() if rng.random() < 0.2 else t
        t = t + " # $" if rng.random() < 0.2 else t
        t = t[:60] * 30 if rng.random() < 0.2 else t
        rows.append((1000 + rng.randrange(280), t, rng.choice(["a", "b", "", None, "only here" if i == 7 else "a"])))
    label_rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1300, 2)] + [(1002, 1, 0), (1002, 0, 1), (None, 1, 1)]
    labels = {}
    for i, q, x in label_rows:
        if i is not None:
            was = labels.get(i, (0, 0))
            labels[i] = (max(was[0], int(q == 1)), max(was[1], int(x == 1)))
    named = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("n", F.lit(9))
    got = filter_audit.filter_audit(table(rows), named)
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, labels)
    assert filter_audit.filter_audit(table([]), named).collect() == []


def test_removal_intervals_are_those_of_the_definition():
    orders = list(itertools.permutations(range(5)))
    removed = {(mask, step, rank) for mask, step, low, high in filter_audit.removal_intervals(5) for rank in range(low, high)}
    want = {(mask, min(s for s in range(1, 6) if mask >> p[s - 1] & 1), rank) for mask in range(1, 32) for rank, p in enumerate(orders)}
    assert removed == want


def test_copies_of_one_text_spread_over_tasks(spark):
    """A third of all rows are one text; the join that finds the first copy is keyed by text and id."""
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {r.mask: r.n for r in filter_audit.mask_counts(docs, labels).collect()}
    assert counts == {1: 2_001, 17: 999}


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_license_scan", "op13_filter_audit"])
def test_registered_with_sql(name):
    from locusloom.llm import queries

    assert name in queries.QUERIES and name in queries.ORACLES

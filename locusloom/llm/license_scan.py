"""Licence scan by ordered signature rules; DataFrame functions only.

A text is normalised once to lower-case words between single spaces. A keyword prefilter intersects its words with
the rules' keywords, so only rules that can match are tried, by a join with the rule table (fixed size, broadcast).
Each match becomes a span of words. Spans of a row are put in order once, and one that lies within a span of the
same or a better tier is suppressed: a notice hides the name in it, the name the hint. No text is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_rules import Rule, all_rules

#: Phrases that are counted whatever the rules find, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
CONFIDENCE = (1.0, 0.9, 0.7, 0.4)  # of tiers 1 to 4
PHRASE_CONFIDENCE = 0.6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Words in lower case (A-Z), each between single spaces, one space at either end; ``' '`` if there is none.

    ``lower`` also changes letters beyond ASCII, to others beyond ASCII: they are no part of any rule, and words stay
    words. Only the Kelvin sign and the dotted capital I would become ASCII letters, so these are put out of its way.
    """
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.regexp_replace(F.lower(F.concat(F.lit(" "), safe, F.lit(" "))), NOT_WORD, " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrase_columns(norm: Column, n_words: Column, phrases: Mapping[str, str]) -> list[Column]:
    """``n_base, first_word, last_word, base_labels`` (array); words before the first and after the last place are counted."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        there, place = F.contains(norm, F.lit(f" {phrase} ")), f" {phrase} "
        counts.append(F.when(there, F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, _spaces(F.substring_index(norm, place, 1))))
        lasts.append(F.when(there, n_words - _spaces(F.substring_index(norm, place, -1)) - len(phrase.split(" "))))
        labels.append(F.when(there, F.lit(label)))
    pick = lambda f, cols: f(*cols) if len(cols) > 1 else cols[0]
    return [
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        pick(F.least, firsts).cast("long").alias("first_word"),
        pick(F.greatest, lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_labels"),
    ]


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """``rule, label, tier, keyword, pattern``: literals, no data of the input."""
    rows = [{"rule": i, "label": r.label, "tier": r.tier, "keyword": r.keyword, "pattern": f"(?<= )(?:{r.pattern})(?= )"} for i, r in enumerate(rules)]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<rule int, label string, tier int, keyword string, pattern string>>")
    return spark.range(1).select(F.inline(listed))


def _spans(docs: DataFrame, rules: Sequence[Rule], phrases: Mapping[str, str], id_col: str, text_col: str) -> DataFrame:
    """``row, doc``, and ``rule, label, tier, start, end`` (words, both included) of each match, with ``kept``.

    Each row of ``docs`` also has one line with ``doc`` (its id and phrase columns) and without a match; ``doc`` is NULL
    in the lines of matches. All lines of a row lie in one partition.
    """
    norm = normalised(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    counted = rows.withColumn("n_words", (_spaces(F.col("norm")) - 1).cast("long"))
    base = counted.select("row", "doc_id", "norm", "n_words", *_phrase_columns(F.col("norm"), F.col("n_words"), phrases))
    doc = F.struct("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    keywords = F.array(*map(F.lit, sorted({r.keyword for r in rules})))
    gate = F.concat(F.array(F.lit("")), F.array_intersect(F.split("norm", " "), keywords))  # '' is the line of the row itself
    gated = base.select("row", "norm", doc.alias("doc"), F.explode(gate).alias("keyword"))
    tried = gated.join(F.broadcast(rule_table(docs.sparkSession, rules)), "keyword", "left")
    # what stands before each match, and the match; made once for each row and rule, then one line for each match
    pairs = F.arrays_zip(F.split("norm", F.col("pattern"), -1).alias("before"), F.regexp_extract_all("norm", F.col("pattern"), F.lit(0)).alias("match"))
    matched = tried.select(
        "row",
        F.when(F.col("keyword") == "", F.col("doc")).alias("doc"),
        *("rule", "label", "tier"),
        F.posexplode_outer(F.when(F.rlike(F.col("norm"), F.col("pattern")), pairs)).alias("k", "pair"),
    ).filter("doc IS NOT NULL OR pair.match IS NOT NULL")
    sized = matched.select("row", "doc", "rule", "label", "tier", "k", _spaces(F.col("pair.before")).alias("gap"), _spaces(F.col("pair.match")).alias("inner"))

    upto = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.sum(F.col("gap") + F.col("inner")).over(upto) - F.col("inner") - 1
    placed = sized.repartition("row").select("row", "doc", "rule", "label", "tier", begin.alias("start"), (begin + F.col("inner")).alias("end"))
    # whatever holds a span comes before it in this order; equal spans go to the better tier, then to the earlier rule
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("tier") <= t, F.col("end"))).over(before) for t in range(1, len(CONFIDENCE) + 1)]
    held = F.element_at(F.array(*reach), F.col("tier")) >= F.col("end")
    return placed.select("row", "doc", "rule", "label", "tier", "start", "end", (F.col("rule").isNotNull() & ~F.coalesce(held, F.lit(False))).alias("kept"))


def license_detections(docs: DataFrame, *, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every rule: ``row`` (number of the row of ``docs``), ``label, tier, start, end, kept``.

    ``start`` and ``end`` are the first and last word, from 0; ``kept`` is false for spans that another one suppresses.
    """
    spans = _spans(docs, rules or all_rules(), PHRASES, id_col, text_col)
    return spans.filter("rule IS NOT NULL").select("row", "rule", "label", "tier", "start", "end", "kept")


def license_scan(
    docs: DataFrame,
    *,
    rules: Sequence[Rule] | None = None,
    phrases: Mapping[str, str] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans``.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. ``n_base`` counts the
    places of all ``phrases``, ``first_word`` and ``last_word`` are the least and greatest word they begin at (NULL if
    none). ``labels`` are those of the phrases and of all kept spans (``n_spans``); both lists are distinct, sorted and
    joined by commas, ``''`` if empty. ``score`` is the confidence of the best tier found, 0 if nothing is.

    NULL and empty texts have no words. Each row is scanned by itself, so ids may be NULL or repeated, and other
    columns are ignored. All spans of one row meet in one task, never those of several rows as one group.
    """
    spans = _spans(docs, rules or all_rules(), phrases, id_col, text_col)
    found = spans.groupBy("row").agg(
        F.max("doc").alias("doc"),
        F.collect_set(F.when(F.col("kept"), F.col("label"))).alias("labels"),  # no more than there are labels
        *[F.max(F.when(F.col("kept") & (F.col("tier") == t), F.lit(c))).alias(f"tier_{t}") for t, c in enumerate(CONFIDENCE, 1)],
        F.count(F.when(F.col("kept"), F.lit(1))).alias("n_spans"),
    )
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    confidence = F.coalesce(*[f"tier_{t}" for t in range(1, len(CONFIDENCE) + 1)], F.lit(0.0))
    return found.select(
        *[f"doc.{c}" for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")],
        joined(F.array_distinct("doc.base_labels")).alias("base_labels"),
        joined(F.array_union("labels", "doc.base_labels")).alias("labels"),
        F.greatest(confidence, F.when(F.col("doc.n_base") > 0, PHRASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        "n_spans",
    )


def oracle(rules: Sequence[Rule] | None = None) -> str:
    """The query in DuckDB: spans by splits of text with doubled spaces, suppression by its definition."""
    doubled = lambda p: p.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    listed = ",\n".join(f"({i}, '{r.label}', {r.tier}, '{r.keyword}', ' (?:{doubled(r.pattern)}) ')" for i, r in enumerate(rules or all_rules()))
    places = " UNION ALL ".join(
        f"SELECT row, '{label}' AS label, i - 1 AS place FROM words, generate_series(1, len(w) - {n - 1}) t(i) WHERE has_{k} AND w[i:i + {n - 1}] = {phrase.split(' ')}"
        for k, (phrase, label) in enumerate(PHRASES.items())
        for n in [len(phrase.split(" "))]
    )
    has = ", ".join(f"contains(norm, ' {phrase} ') AS has_{k}" for k, phrase in enumerate(PHRASES))
    return f"""
WITH rules(rule, label, tier, keyword, pattern) AS (VALUES {listed}),
texts AS (
    SELECT row_number() OVER () AS row, doc_id,
           ' ' || array_to_string(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') || ' ' AS norm
    FROM documents),
words AS (SELECT row, doc_id, norm, string_split(trim(norm, ' '), ' ') AS w, replace(norm, ' ', '  ') AS wide, {has} FROM texts),
places AS ({places}),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base_labels FROM places GROUP BY row),
tried AS (
    SELECT row, rule, label, tier, regexp_split_to_array(wide, pattern) AS pieces, regexp_extract_all(wide, pattern) AS found
    FROM words JOIN rules ON contains(norm, ' ' || keyword || ' ')),
sizes AS (
    SELECT row, rule, label, tier, k, len(regexp_extract_all(pieces[k], '[^ ]+')) AS gap, len(regexp_extract_all(found[k], '[^ ]+')) AS inner_words
    FROM (SELECT *, unnest(generate_series(1, len(found))) AS k FROM tried WHERE len(found) > 0)),
spans AS (
    SELECT row, rule, label, tier, sum(gap + inner_words) OVER (PARTITION BY row, rule ORDER BY k) - inner_words AS start,
           sum(gap + inner_words) OVER (PARTITION BY row, rule ORDER BY k) - 1 AS stop
    FROM sizes),
kept AS (
    SELECT * FROM spans a WHERE NOT EXISTS (
        SELECT 1 FROM spans b WHERE b.row = a.row AND b.start <= a.start AND b.stop >= a.stop AND b.tier <= a.tier
        AND (b.start < a.start OR b.stop > a.stop OR b.tier < a.tier OR b.rule < a.rule))),
named AS (SELECT row, list(DISTINCT label) AS labels, min(tier) AS tier, count(*) AS n_spans FROM kept GROUP BY row)
SELECT doc_id, CASE WHEN norm = '  ' THEN 0 ELSE len(w) END::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(base_labels, [])))), ',') AS labels,
       greatest(coalesce({list(CONFIDENCE)}[tier], 0.0), CASE WHEN n_base > 0 THEN {PHRASE_CONFIDENCE} ELSE 0.0 END)::DOUBLE AS score,
       coalesce(n_spans, 0)::BIGINT AS n_spans
FROM words LEFT JOIN base USING (row) LEFT JOIN named USING (row)
"""

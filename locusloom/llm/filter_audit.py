"""Audit of how filters interact over all their orders, by difference arrays over Lehmer ranks.

Each document fails a set of filters, its mask. In a given order it is removed at the step of its first failing
filter. Orders that begin alike have ranks next to each other in lexicographic order (the Lehmer code of a prefix
gives the first rank, a factorial the number of ranks), so for one mask and step the orders that remove it there
form a few rank intervals. Documents are counted by part and mask; counts are added where an interval begins and
taken off where it ends, and running sums over the ranks give what each order removes at each step.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def lehmer_rank(prefix: tuple[int, ...], m: int) -> int:
    """Rank of the first permutation of ``0..m-1`` that begins with ``prefix``."""
    return sum(sum(x < p and x not in prefix[:i] for x in range(m)) * factorial(m - 1 - i) for i, p in enumerate(prefix))


def removal_intervals(m: int) -> list[tuple[int, int, int, int]]:
    """``(mask, step, first rank, last rank + 1)`` of the orders that remove a document of that mask at that step.

    Fixed in size by the number of filters: 2,605 rows for five.
    """
    out = []
    for step in range(1, m + 1):
        for prefix in permutations(range(m), step):
            low = lehmer_rank(prefix, m)
            passed = sum(1 << f for f in prefix[:-1])
            for mask in range(1, 1 << m):
                if mask & (1 << prefix[-1]) and not mask & passed:
                    out.append((mask, step, low, low + factorial(m - step)))
    return out


def with_failures(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``failed``, bits 0 to 3: under 200 words, fewer distinct ones than half, capitals over 2 %, a symbol of ``[#$%&*|]``."""
    split = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))  # a column, so that it is split once
    sized = split.withColumn("total", F.size("words").cast("long")).withColumn("distinct", F.size(F.array_distinct("words")).cast("long")).drop("words")
    capitals = F.regexp_count("text", F.lit("[A-Z]")).cast("long")
    failures = [
        F.col("total") < 200,
        100 * F.col("distinct") < 50 * F.col("total"),
        100 * capitals > 2 * F.length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failures)), F.lit(0)).cast("int")
    return sized.withColumn("failed", bits).drop("text", "total", "distinct")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and set of filters failed.

    Equal texts are found by their SHA-256. Which copy is the first is settled by a join on digest *and* id, so the
    copies of one text spread over all tasks; equal rows are folded before any shuffle of them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")
    )
    rows = with_failures(rows.withColumn("digest", F.unhex(F.sha2("text", 256))))
    folded = written(rows.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n")), "folded")
    marks = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("is_toxic"))
    counted = folded.join(marks, "doc_id", "left").select(
        "doc_id", "part", "digest", "failed", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(a) for c, a in (("is_good", "good"), ("is_toxic", "toxic"))]
    )
    first = folded.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    alone = counted.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    passes = F.col("first").isNotNull() | F.col("doc_id").isNull()
    mask = (F.col("failed") + F.when(passes, 0).otherwise(16)).alias("mask")
    return alone.groupBy("part", mask).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def order_totals(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of filters and step, from ``counts(part, mask, n, good, toxic)``.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. What is kept
    of a part in memory is bounded by the number of orders; parts are dealt out by hash.
    """
    spark, m = counts.sparkSession, len(filters)
    orders = ["".join(p) for p in permutations(filters)]
    intervals = F.broadcast(spark.createDataFrame(removal_intervals(m), "mask int, step int, low int, high int"))  # fixed size
    met = counts.join(intervals, "mask")
    begins = met.select("part", "step", F.col("low").alias("rank"), *COUNTS)
    ends = met.select("part", "step", F.col("high").alias("rank"), *[(-F.col(c)).alias(c) for c in COUNTS])
    # every rank of every step, so that totals stand where nothing begins or ends
    frame = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("step"))
    frame = frame.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    changes = begins.unionByName(ends).unionByName(frame).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = changes.select("part", "step", "rank", *[F.sum(c).over(upto).alias(c) for c in COUNTS]).filter(F.col("rank") < len(orders))

    order = F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1)
    named = totals.withColumn("filter_order", order).withColumn("filter", F.instr(F.lit(filters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1)
    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    of_part = counts.groupBy("part").agg(
        F.sum("n").alias("all"),
        F.array(*[F.sum(F.when(bit(i), F.col("n")).otherwise(0)) for i in range(m)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == (1 << i), F.col("n")).otherwise(0)) for i in range(m)]).alias("only"),
    )
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("part", "filter")
    at = F.col("filter") + 1
    return (
        named.join(of_part, "part")
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("all") - F.sum("n").over(so_far)).alias("kept"),
            F.col("n").alias("removed"),
            (F.element_at("fails", at) - F.col("n")).alias("redundant"),
            F.element_at("only", at).alias("unique_fails"),
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            F.sum("n").over(every).alias("shapley"),
        )
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters over ``docs(doc_id, text, source)`` in all 120 orders, with ``labels(doc_id, quality, toxic)``.

    Failure: A under 200 words; B fewer distinct words than half; C capitals over 2 % of code points; D a symbol of
    ``[#$%&*|]``; E the text of any smaller id. Columns as in ``order_totals``; ``part`` is the source.

    NULL texts are empty, NULL sources are the part ``''``. A row without an id fails E never, makes no other row
    fail it, and has no label. Rows of one id and equal text don't fail E for each other; each counts. A label
    counts if any row of ``labels`` gives it to the id. Without documents there are no parts and no rows. Other
    columns are ignored.
    """
    return order_totals(written(mask_counts(docs, labels), "masks"))


#: the query in DuckDB: each step of each order counted by its definition
ORACLE = r"""
WITH lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
base AS (
    SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS text, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS words,
           coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
    FROM documents d LEFT JOIN lab l USING (doc_id)),
masks AS (
    SELECT part, good, toxic,
           (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
           + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
           + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
    FROM base),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
totals AS (
    SELECT part, filter_order, step::INT AS step, bit,
           sum(n) FILTER (mask & (coalesce(earlier, 0)::INT | bit) = 0) AS kept,
           sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::INT = 0) AS removed,
           sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::INT <> 0) AS redundant,
           sum(n) FILTER (mask = bit) AS unique_fails,
           sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::INT = 0) AS good_lost,
           sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::INT = 0) AS toxic_lost
    FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM totals
"""

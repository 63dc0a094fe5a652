"""Mixing of sources to target weights by weighted fair queueing; DataFrame operations only.

Each document waits in the queue of its source, in a shuffled order that reruns repeat. It gets a virtual
finish time: the words its source has served when half of the document is served, over the source's target.
A source whose target exceeds its size goes round again, at most ``MOST_REPEATS`` times in all. The copies of
all sources are sorted by virtual time over range partitions, and the mix takes those that come before the
total budget is used up (half of a copy must fit), so every source ends about half a document from its target.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def ordered_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """Add running sums (the row itself included) over one order of all rows: ``{new column: summed column}``.

    Rows are range-partitioned by ``order`` and written, each with the number of its partition; sums run inside
    the partitions and one row per partition carries them on. So no key is gathered in one task, however many
    rows share it. ``order`` should be unique, else ties fall in any order.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    carry = totals.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in sums])
    rows = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    return rows.join(carry, "_part").select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_carry_{n}")).alias(n) for n in sums])


def source_targets(sources: DataFrame, total: int, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``weight``, ``target`` and ``words_before`` to rows ``(source, source_size)``.

    Sources by code point, NULL last, weigh ``weights`` in turn and share ``total``; none gets more than ``most``
    times its size. The level at which all share alike is the largest of those that result when the sources with
    the least ``cap / weight`` are taken at their cap one after another.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    named = ordered_sums(
        sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"rank": "one", "words_to": "source_size"}
    )
    weighed = named.select(
        "source",
        "source_size",
        (F.col("words_to") - F.col("source_size")).alias("words_before"),
        F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    filled = ordered_sums(
        weighed.withColumn("fill", F.col("cap") / F.col("weight")), [F.col("fill"), F.col("source").asc_nulls_last()], {"caps": "cap", "weights": "weight"}
    )
    all_weights = weighed.agg(F.sum("weight")).first()[0] or 0
    rest = F.lit(all_weights) - F.col("weights") + F.col("weight")
    level = filled.agg(F.max((F.lit(total) - F.col("caps") + F.col("cap")) / rest)).first()[0] or 0.0
    return weighed.select(
        "source", "source_size", "words_before", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))).alias("target")
    )


def fair_queue(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = 42,
) -> DataFrame:
    """The queue of all copies: ``row, doc_id, size, source_size, target, copy, virtual_time, served, taken``.

    ``size`` counts words (NULL text: 0), ``copy`` goes from 0, ``served`` is the sum of sizes up to the copy in
    the order of virtual time, ``taken`` tells whether the mix takes it. A document without words is queued and
    takes nothing. Repeated rows wait as documents of their own. NULL sources are one source.
    """
    sized = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    ).withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = source_targets(sources, total, weights, most)

    # running words in the order (source, shuffled); a source's own count begins where the others end
    lined = ordered_sums(sized, [F.col("source").asc_nulls_last(), F.col("shuffled"), F.col("doc_id"), F.col("row")], {"words_to": "size"})
    t = targets.withColumnRenamed("source", "named")
    waiting = lined.join(t, lined["source"].eqNullSafe(t["named"])).select(
        "row", "doc_id", "size", "source_size", "target", "shuffled", (F.col("words_to") - F.col("words_before") - F.col("size") / 2).alias("half_served")
    )
    rounds = F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")).cast("int") + 1)
    copies = waiting.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("source_size") > 0, rounds - 1).otherwise(0))))
    timed = copies.withColumn(
        "virtual_time", F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + F.col("half_served")) / F.col("target")).otherwise(0.0)
    )
    served = ordered_sums(timed, [F.col("virtual_time"), F.col("copy"), F.col("shuffled"), F.col("doc_id"), F.col("row")], {"served": "size"})
    return served.select(
        "row", "doc_id", "size", "source_size", "target", "copy", "virtual_time", "served",
        ((F.col("target") > 0) & (F.col("served") - F.col("size") / 2 <= F.lit(total))).alias("taken"),
    )


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken`` (words taken, repeats counted)."""
    return (
        fair_queue(docs, **options)
        .groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed documents, with all their columns: each as many times as the mix takes it.

    ``docs`` must have no two different rows of one id; equal rows are taken as often as all of them together.
    """
    queue = fair_queue(docs, id_col=id_col, **options)
    times = queue.filter("taken AND size > 0").groupBy(F.col("doc_id").alias("_mix_id")).agg(F.count("*").cast("int").alias("_mix_times"))
    once = docs.dropDuplicates([id_col])
    return (
        once.join(times, once[id_col] == times["_mix_id"])
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
        .select(*[once[c] for c in docs.columns])
    )

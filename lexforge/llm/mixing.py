"""Mixing sources to target weights by weighted fair queueing, DataFrame operations only.

Within each source the documents are put into a seeded random order and get a
virtual finish time: the source's words up to and including the document,
divided by the source's weight; the k-th repeat of a source goes on where the
one before ended.  All copies are range-sorted by finish time and the order is
cut where the running total reaches the budget.  A source whose repeats are
used up drops out of the queue, so the others share what it leaves by weight.

Defined results: a null source is a source of its own, ordered last; a null
text has size 0, and so does a null size; repeated rows are documents of their
own; ties in finish time are ordered by source, repeat and shuffle key; an
empty table gives an empty result; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import (free_name, group_key, reliable_checkpoint, running_in_group,
                                 seeded_hash, without)
from lexforge.operators.positions import ordered_running

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] | Mapping[str, float],
                   budget_share: float, max_repeats: int) -> DataFrame:
    """(key, source_size, weight, target, budget) per source, from (key, size) rows.

    ``weights`` repeat over the sources in key order, or are given by source
    (1.0 where missing).  Targets share the budget by weight but stop at
    ``max_repeats`` times the source's size; what is over is shared again.
    The windows run over one row per source, as long as the list of weights
    that a mixture needs.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, Mapping):
        weight = F.lit(1.0)
        for name, w in weights.items():
            weight = F.when(F.col("key") == f"0{name}", F.lit(float(w))).otherwise(weight)
    else:
        turn = F.row_number().over(Window.orderBy("key")) - 1
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                              (turn % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    per = (per.withColumn("weight", weight)
           .withColumn("cap", F.col("source_size") * float(max_repeats))
           .withColumn("budget", F.sum("source_size").over(every) * float(budget_share)))
    # sources in the order in which a rising water level (words per weight) fills them
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("budget") - full) / open_weight)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    per = per.withColumn("level", F.coalesce(F.max(fits).over(every), F.lit(float("inf"))))
    return per.select("key", "source_size", "weight", "budget",
                      F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column, source_col: str = "source", identity: Sequence[str] = ("doc_id", "text"),
        weights: Sequence[float] | Mapping[str, float] = (5.0, 2.0, 1.0), budget_share: float = 1.5,
        max_repeats: int = 2, seed: int = 1) -> DataFrame:
    """``docs`` with size, source_size, weight, target, finish and copies.

    ``copies`` says how often the mix takes the document (0 to
    ``max_repeats``), ``finish`` is the virtual finish time of its first copy.
    ``identity`` names the columns that the shuffle hashes.
    """
    added = ("size", "source_size", "weight", "target", "finish", "copies")
    taken = {source_col, *identity}
    size_value = F.coalesce(size, F.lit(0)).cast("long")
    key, order = free_name(docs, "_key"), free_name(docs, "_order")
    wide = (docs.withColumns({key: group_key(F.col(source_col)),
                              order: seeded_hash(seed, *[F.col(c) for c in identity]),
                              free_name(docs, "_size"): size_value}))
    wide = without(wide, [a for a in added if a not in {c.lower() for c in taken}])
    wide = wide.withColumnRenamed(free_name(docs, "_size"), "size")
    slim = reliable_checkpoint(wide.select(F.col(key).alias("key"), F.col(order).alias("order"), "size"))
    sources = reliable_checkpoint(source_targets(slim, weights, budget_share, max_repeats))
    schedule = running_in_group(slim, "key", "order", F.col("size"), "upto").join(sources, "key")
    copies = schedule.select("key", "order", "size", "budget", F.explode(
        F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: F.struct(
            k.alias("k"), ((k * F.col("source_size") + F.col("upto")) / F.col("weight")).alias("finish"))
        )).alias("copy")).select("key", "order", "size", "budget", "copy.*")
    queue = ordered_running(copies, ["finish", "key", "k", "order"], pos_col=None, sums={"before": "size"})
    last = queue.where(F.col("before") + F.col("size") <= F.col("budget")).agg(
        F.max(F.struct("finish", "key", "k", "order")).alias("last")).first()["last"]

    slices = slim.withColumnsRenamed({"key": key, "order": order})
    upto = free_name(wide, "_upto")
    out = running_in_group(wide, key, order, F.col("size"), upto, parts=slices)
    out = out.join(sources.withColumnRenamed("key", key).drop("budget"), key)
    if last is None:
        out = out.withColumn("copies", F.lit(0))
    else:
        cut = F.struct(F.lit(last.finish), F.lit(last.key), F.lit(last.k), F.lit(last.order))
        out = out.withColumn("copies", sum((F.struct(
            (F.lit(k) * F.col("source_size") + F.col(upto)) / F.col("weight"), F.col(key), F.lit(k),
            F.col(order)) <= cut).cast("int") for k in range(max_repeats)))
    return out.withColumn("finish", F.col(upto) / F.col("weight")).drop(key, order, upto)


def mixed(docs: DataFrame, size: Column, **kw) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its old columns only."""
    names = docs.columns
    plan = mix(docs, size, **kw).where("copies > 0")
    copy = free_name(plan, "_copy")
    return plan.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)

"""Proportional stratified interleaving: shards that each match the mixture.

Rows are put into a seeded random order within their source and ranked; the
fractional rank (rank - 0.5) / (rows of the source) spreads every source
evenly over (0, 1).  A global sort by fractional rank interleaves the sources,
and equal cuts of that order are the shards: counts differ by at most one and
each shard holds each source in proportion.  Equal texts are not kept
together, since the law is equal counts.

Defined results: a null source is a source of its own; repeated rows are rows
of their own; equal fractional ranks are ordered by source; an empty table
gives an empty result; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import (free_name, group_key, reliable_checkpoint, running_in_group,
                                 seeded_hash, without)
from lexforge.operators.positions import ordered_running


def shard(docs: DataFrame, n_shards: int = 40, source_col: str = "source",
          identity: Sequence[str] = ("doc_id", "text"), seed: int = 2) -> DataFrame:
    """``docs`` with shard (0 to n_shards - 1) and slot (gapless from 0 in its shard)."""
    keep = {source_col.lower(), *(c.lower() for c in identity)}
    docs = without(docs, [c for c in ("shard", "slot") if c not in keep])
    key, order = free_name(docs, "_key"), free_name(docs, "_order")
    rank, rows, frac, pos = (free_name(docs, x) for x in ("_rank", "_rows", "_frac", "_pos"))
    keyed = docs.withColumns({key: group_key(F.col(source_col)),
                              order: seeded_hash(seed, *[F.col(c) for c in identity])})
    slim = reliable_checkpoint(keyed.select(key, order))
    total = max(slim.count(), 1)
    per = slim.groupBy(key).agg(F.count(F.lit(1)).alias(rows))
    ranks = running_in_group(slim, key, order, F.lit(1), rank).join(per, key)
    placed = ordered_running(ranks.select(key, rank, ((F.col(rank) - 0.5) / F.col(rows)).alias(frac)),
                             [frac, key], pos_col=pos)
    # exact integer arithmetic: shard = pos * shards div rows, and the first pos of a shard
    placed = placed.withColumn("shard", F.expr(f"cast(({pos} * {n_shards}L) div {total}L as int)"))
    first = F.expr(f"(cast(shard as long) * {total}L + {n_shards - 1}L) div {n_shards}L")
    placed = placed.select(key, rank, "shard", (F.col(pos) - first).alias("slot"))
    # a source and a rank in it name one row: the rows themselves join the places by them
    ranked = running_in_group(keyed, key, order, F.lit(1), rank, parts=slim)
    return ranked.join(placed, [key, rank]).drop(key, order, rank)

"""Dense positions and running totals without a single-task window (survey 7.2).

An unpartitioned ``row_number()`` or running ``sum()`` pulls every row into
one task.  Both primitives here split the order into contiguous *chunks*,
summarise each chunk (one small row per chunk), prefix-sum that small table,
and add the carry back to a row-level window that is partitioned by chunk:

* :func:`hash_order_positions` - the order key is an md5 hex string, so its
  leading hex digits are already a uniform range bucket.  No global sort
  and no checkpoint (rows are sorted only within their bucket); the carry
  table has at most ``16**digits`` rows and is broadcast with that bound.
* :func:`ordered_running` - any order.  A range-partitioned sort (sampled
  bounds, so one hot key value is split across many partitions) is written
  to the reliable checkpoint folder, which pins partition membership; each
  partition (within each group) is one chunk.

Both work per group (``partition``) and survive a group holding a large
share of all rows, because chunks - not groups - bound the window size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.hashing import hex_bucket
from lexforge.session import reliable_checkpoint


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_order_positions(df: DataFrame, key: str, tie, pos_col: str = "pos",
                         partition: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """0-based dense position of each row in ``(key, tie)`` order, per group.

    ``key`` must be an md5 hex column; ``tie`` (a column name or a list of
    names) breaks equal hashes.  The
    bucket is the first ``digits`` hex digits, a contiguous slice of the
    order, so the within-bucket rank plus the count of all smaller buckets is
    the global rank.
    """
    part = list(partition)
    b = "_bucket"
    # the same hash exchange on the bucket feeds the counts and the ranking
    shuffled = df.withColumn(b, hex_bucket(F.col(key), digits)).repartition(*part, b)
    counts = shuffled.groupBy(*part, b).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*part, b, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    if not part:
        # at most 16**digits rows: a proven bound for the broadcast
        carry = F.broadcast(carry)
    ties = [tie] if isinstance(tie, str) else list(tie)
    rank_w = Window.partitionBy(*part, b).orderBy(F.col(key), *[F.col(t) for t in ties])
    ranked = shuffled.withColumn("_rn", F.row_number().over(rank_w))
    return (ranked.join(carry, [*part, b])
            .withColumn(pos_col, (F.col("_start") + F.col("_rn") - 1).cast("long"))
            .drop(b, "_rn", "_start"))


def ordered_running(df: DataFrame, order: Sequence, partition: Sequence[str] = (),
                    pos_col: str | None = "pos", sums: dict | None = None,
                    maxes: dict | None = None, checkpoint: bool = True,
                    small: bool = False) -> DataFrame:
    """Dense position plus exclusive running sums/maxes, in ``order`` per group.

    ``sums``/``maxes`` map output name -> input column; the output is the
    aggregate over all *earlier* rows of the same group (sum 0 / max NULL
    when there are none).  ``order`` must be a total order within a group
    (include a unique tie-breaker).

    ``small=True`` is for tables whose size is bounded by a parameter (e.g.
    one row per shard): a plain window, no sort job, no checkpoint.
    """
    sums = dict(sums or {})
    maxes = dict(maxes or {})
    part = list(partition)
    if small:
        w = Window.partitionBy(*part).orderBy(*[_col(o) for o in order])
        prev = w.rowsBetween(Window.unboundedPreceding, -1)
        out = df
        if pos_col:
            out = out.withColumn(pos_col, (F.row_number().over(w) - 1).cast("long"))
        for o, c in sums.items():
            out = out.withColumn(o, F.coalesce(F.sum(_col(c)).over(prev), F.lit(0)))
        for o, c in maxes.items():
            out = out.withColumn(o, F.max(_col(c)).over(prev))
        return out
    keys = [*(F.col(p) for p in part), *(_col(o) for o in order)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if checkpoint:
        ranged = reliable_checkpoint(ranged)
    t = ranged.withColumn("_pid", F.spark_partition_id())

    # a checkpoint keeps each partition's rows in their order, so for positions alone a row's
    # place in its partition is its rank in the chunk: no window, which would move all rows again
    placed = checkpoint and bool(pos_col) and not sums and not maxes
    if placed:
        t = t.withColumn("_rn", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))

    # one row per (chunk, group): count and chunk totals
    chunk_aggs = [F.count(F.lit(1)).alias("_n")]
    chunk_aggs += [F.min("_rn").alias("_first")] if placed else []
    chunk_aggs += [F.sum(_col(c)).alias(f"_s_{o}") for o, c in sums.items()]
    chunk_aggs += [F.max(_col(c)).alias(f"_m_{o}") for o, c in maxes.items()]
    chunks = t.groupBy("_pid", *part).agg(*chunk_aggs)
    cw = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.coalesce(F.sum("_n").over(cw), F.lit(0)).alias("_n0")]
    if placed:                                             # a group's rows are one stretch of the chunk
        carry_cols = [(carry_cols[0] - F.col("_first") + 1).alias("_n0")]
    carry_cols += [F.coalesce(F.sum(f"_s_{o}").over(cw), F.lit(0)).alias(f"_s0_{o}") for o in sums]
    carry_cols += [F.max(f"_m_{o}").over(cw).alias(f"_m0_{o}") for o in maxes]
    carry = chunks.select("_pid", *part, *carry_cols)
    if not part:
        # one row per partition of the checkpointed sort: bounded by the
        # partition count, so broadcasting it is safe at any data size
        carry = F.broadcast(carry)

    lw = Window.partitionBy("_pid", *part).orderBy(*[_col(o) for o in order])
    before = lw.rowsBetween(Window.unboundedPreceding, -1)
    local = t if placed else t.withColumn("_rn", F.row_number().over(lw))
    for o, c in sums.items():
        local = local.withColumn(f"_ls_{o}", F.coalesce(F.sum(_col(c)).over(before), F.lit(0)))
    for o, c in maxes.items():
        local = local.withColumn(f"_lm_{o}", F.max(_col(c)).over(before))

    out = local.join(carry, ["_pid", *part])
    if pos_col:
        out = out.withColumn(pos_col, (F.col("_n0") + F.col("_rn") - 1).cast("long"))
    for o in sums:
        out = out.withColumn(o, F.col(f"_s0_{o}") + F.col(f"_ls_{o}"))
    for o in maxes:
        out = out.withColumn(o, F.greatest(F.col(f"_m0_{o}"), F.col(f"_lm_{o}")))
    drop = ["_pid", "_rn", "_n0"]
    drop += [f"_s0_{o}" for o in sums] + [f"_ls_{o}" for o in sums]
    drop += [f"_m0_{o}" for o in maxes] + [f"_lm_{o}" for o in maxes]
    return out.drop(*drop)


class OrderedScan:
    """Segmented prefix scans over one sort.

    The rows are range-sorted by group and ``order`` and checkpointed once.
    Each :meth:`add` then puts running sums and latest marked values beside the
    rows: one small row a chunk (and group) carries what lies before, a window
    inside the chunk does the rest.  A later ``add`` may build on the columns of
    an earlier one, so a mark can depend on a position or on the row before.
    """

    def __init__(self, df: DataFrame, order: Sequence, partition: Sequence[str] = ()):
        self.part = list(partition)
        self.order = [_col(o) for o in order]
        keys = [*(F.col(p) for p in self.part), *self.order]
        ranged = reliable_checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
        self.rows = ranged.withColumn("_pid", F.spark_partition_id())

    def add(self, sums: dict | None = None, latest: dict | None = None) -> OrderedScan:
        """``sums``: output -> (column, inclusive).  ``latest``: output -> (mark, value, inclusive),
        the value at the latest marked row; values have to grow with the order, and what is
        the largest struct counts (null without a mark)."""
        parts = [(o, F.sum, _col(c), inc) for o, (c, inc) in (sums or {}).items()]
        parts += [(o, F.max, F.when(mark, value), inc) for o, (mark, value, inc) in (latest or {}).items()]
        rows = self.rows
        for i, (_, _, c, _) in enumerate(parts):
            rows = rows.withColumn(f"_c{i}", c)
        earlier = (Window.partitionBy(*self.part).orderBy("_pid")
                   .rowsBetween(Window.unboundedPreceding, -1))
        carry = (rows.groupBy("_pid", *self.part).agg(*[f(f"_c{i}").alias(f"_k{i}") for i, (_, f, _, _) in enumerate(parts)])
                 .select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{j}") for j, g in enumerate(self.part)],
                         *[f(f"_k{i}").over(earlier).alias(f"_k{i}") for i, (_, f, _, _) in enumerate(parts)]))
        same = F.col("_pid") == F.col("_p")
        for j, g in enumerate(self.part):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{j}"))
        inside = Window.partitionBy("_pid", *self.part).orderBy(*self.order)
        for i, (_, f, _, inc) in enumerate(parts):
            rows = rows.withColumn(f"_l{i}", f(f"_c{i}").over(
                inside.rowsBetween(Window.unboundedPreceding, 0 if inc else -1)))
        rows = rows.join(carry, same)
        for i, (o, f, _, _) in enumerate(parts):
            rows = rows.withColumn(o, F.coalesce(f"_k{i}", F.lit(0)) + F.coalesce(f"_l{i}", F.lit(0)) if f is F.sum
                                   else F.greatest(f"_k{i}", f"_l{i}"))
        self.rows = rows.drop("_p", *[f"_g{j}" for j in range(len(self.part))],
                              *[f"_{k}{i}" for k in "ckl" for i in range(len(parts))])
        return self

    def result(self) -> DataFrame:
        return self.rows.drop("_pid")

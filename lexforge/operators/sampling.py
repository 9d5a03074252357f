"""Seeded shuffles, exact samples, shards and fixed-size chunks (survey C1, C3, D1-D7).

Randomness is an md5 of (seed, key): the same seed and keys give the same
order on any cluster, on retries and in the SQL oracle.  Positions come from
:mod:`lexforge.operators.positions`, never from a single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.hashing import hash_key
from lexforge.operators.positions import hash_order_positions, ordered_running


def shuffle_positions(df: DataFrame, id_col, seed: int, pos_col: str = "pos",
                      partition: Sequence[str] = (), key_parts: Sequence[str] | None = None,
                      digits: int | None = None) -> DataFrame:
    """Dense 0-based position in the seeded random order.

    Order key = ``md5(seed:key_parts...)``, ties by ``id_col`` (name or list
    of names); per group when ``partition`` is given.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    parts = list(key_parts) if key_parts else ids
    keyed = df.withColumn("_hkey", hash_key(seed, *parts))
    d = digits if digits is not None else (2 if partition else 4)
    return hash_order_positions(keyed, "_hkey", id_col, pos_col, partition, d).drop("_hkey")


def stable_positions(df: DataFrame, order: Sequence, pos_col: str = "pos",
                     partition: Sequence[str] = ()) -> DataFrame:
    """Dense position in a deterministic (non-random) order, e.g. id order."""
    return ordered_running(df, list(order), partition, pos_col=pos_col)


def prefix_select(df: DataFrame, pos_col: str, n: int) -> DataFrame:
    """The first ``n`` rows of a positioned table (distributed filter)."""
    return df.where(F.col(pos_col) < n)


#: rows whose keys are sorted to find the last one that stays; larger stretches are counted first
REFINE = 1_000_000


def hash_cut(df: DataFrame, key: str, ties: Sequence[str], n: int, digits: int = 3) -> DataFrame:
    """The ``n`` rows that come first by (``key``, ``ties``), by selection, not by ranking.

    ``key`` is an md5 hex column, so counts by its leading digits (at most
    16**digits rows) tell in which stretch the n-th key lies; that stretch is
    counted by its next digits until it is small, then its keys alone are
    sorted.  The rows are filtered where they are scanned: none is shuffled.
    """
    if n <= 0:
        return df.limit(0)
    known, left, rows = "", n, df.select(key, *ties).where(F.col(key).isNotNull())
    while True:
        size = len(known) + digits
        head = F.substring(key, 1, size)
        counts = sorted((r["h"], r["n"]) for r in rows.groupBy(head.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect())
        for h, m in counts:
            if left <= m:
                break
            left -= m
        else:
            return df if not known else df.where(F.substring(key, 1, len(known)) <= known)
        known, rows = h, rows.where(head == h)
        if m <= REFINE or size + digits > 32:
            break
    order = F.struct(key, *ties)
    last = rows.select(order.alias("k")).orderBy("k").limit(left).agg(F.max("k").alias("k")).select("k.*").first()
    edge = F.struct(*[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in (key, *ties)])
    # the head alone decides nearly every row
    return df.where((head <= known) & (order <= edge))


def first_rows(df: DataFrame, order_col: str, n: int, bins: int = 1024) -> DataFrame:
    """The rows whose integer ``order_col`` is among the ``n`` smallest (equal ones all), by selection.

    The range of values is counted in ``bins`` equal parts, then the part that
    holds the n-th value, until its keys are few enough to be sorted; a filter on
    the scan does the rest.  Null orders last."""
    if n <= 0:
        return df.limit(0)
    at = F.col(order_col)
    keys = df.select(order_col)
    size = keys.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(at).alias("n"), F.count(F.lit(1)).alias("all")).first()
    if n >= size["all"] or size["n"] == 0:
        return df
    if n > size["n"]:                                     # nulls are equal: all of them
        return df
    lo, hi, left, inside = size["lo"], size["hi"], n, size["n"]
    while inside > REFINE and hi > lo:
        width = (hi - lo) // bins + 1
        part = keys.where(at.between(lo, hi)).groupBy(F.floor((at - lo) / width).cast("long").alias("b"))
        for b, inside in sorted((r["b"], r["n"]) for r in part.agg(F.count(F.lit(1)).alias("n")).collect()):
            if left <= inside:
                break
            left -= inside
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
    last = keys.where(at.between(lo, hi)).orderBy(at).limit(left).agg(F.max(at)).first()[0]
    return df.where(at <= last)


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly ``min(n, N)`` rows without replacement, reproducible by seed.

    Unlike ``df.sample`` (approximate size) this keeps the ``n`` smallest
    seeded hashes; only rows that stay are ranked, and none goes through the driver.
    """
    keyed = df.withColumn("_hkey", hash_key(seed, id_col))
    kept = hash_cut(keyed, "_hkey", [id_col], n).drop("_hkey")
    return prefix_select(shuffle_positions(kept, id_col, seed, "sample_pos"), "sample_pos", n)


def assign_shards(df: DataFrame, pos_col: str, n_shards: int,
                  mode: str = "contiguous", shard_col: str = "shard",
                  total=None) -> DataFrame:
    """D3: shard index of each positioned row.

    ``strided``: ``pos % n``.  ``contiguous``: consecutive blocks where the
    first ``N % n`` shards hold one extra row (N from a scalar subquery;
    pass ``total`` - e.g. a count of the unpositioned source - to avoid
    evaluating the positioning plan twice).
    """
    pos = F.col(pos_col)
    if mode == "strided":
        return df.withColumn(shard_col, (pos % n_shards).cast("int"))
    if mode != "contiguous":
        raise ValueError(f"unknown shard mode {mode!r}")
    if total is None:
        total = df.agg(F.count(F.lit(1))).scalar()
    # bind the total once (one subquery), derive block sizes from it
    t = df.withColumn("_div", F.floor(total / n_shards)).withColumn("_mod", total % n_shards)
    big = (F.col("_div") + 1) * F.col("_mod")
    shard = F.when(pos < big, F.floor(pos / (F.col("_div") + 1))).otherwise(
        F.col("_mod") + F.floor((pos - big) / F.greatest(F.col("_div"), F.lit(1))))
    return t.withColumn(shard_col, shard.cast("int")).drop("_div", "_mod")


def shard_prefix(df: DataFrame, max_shard: int, shard_col: str = "shard") -> DataFrame:
    """Keep shards ``0..max_shard`` (partition pruning when shard is a
    partition column of the source)."""
    return df.where(F.col(shard_col) <= max_shard)


def chunk(df: DataFrame, pos_col: str, size: int, file_col: str = "file_idx",
          row_col: str = "row_in_file") -> DataFrame:
    """Fixed-size files over a dense position (last file short)."""
    pos = F.col(pos_col)
    return (df.withColumn(file_col, F.floor(pos / size).cast("int"))
            .withColumn(row_col, (pos % size).cast("long")))

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.session import ROW_GROUP, checkpoint_dir, reliable_checkpoint, written

__all__ = ["bounded_batches", "discard", "free_name", "group_key", "hash_bitmap", "in_bitmap",
           "reliable_checkpoint", "running_in_group", "seeded_hash", "small_batches", "without", "written", "written_buckets"]


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns an operator is about to add.

    Spark resolves names without case, so an input column that clashes with an
    output column in any case is replaced by the output column.
    """
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_name(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def group_key(col: Column) -> Column:
    """A non-null string key that orders by code point with null last."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col.cast("string")))


def seeded_hash(seed: int, *cols: Column) -> Column:
    """A reproducible shuffle key of 60 bits, 0 or more: the head of an md5.

    Values are joined as strings, null as ``\\N``, so DuckDB gets the same key.
    """
    parts = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def running_in_group(df: DataFrame, group: str, order: str, value: Column, out: str,
                     parts: DataFrame | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per ``group`` in the order of the hash ``order``.

    The top 12 bits of the hash cut every group, a hot one too, into 4,096
    even slices: slice sums (one small row each) are prefix-summed per group
    and joined back, and the row-level window runs within a slice.  ``parts``
    may hold the same rows with fewer columns, to take the slice sums from.
    """
    cut = free_name(df, "_slice")
    before = free_name(df, "_before")
    slice_of = F.shiftright(F.col(order), 48)
    sums = ((df if parts is None else parts).withColumn(cut, slice_of)
            .groupBy(group, cut).agg(F.sum(value).alias(before)))
    earlier = Window.partitionBy(group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    inside = (Window.partitionBy(group, cut).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn(cut, slice_of).join(carry, [group, cut])
            .withColumn(out, F.col(before) + F.sum(value).over(inside)).drop(cut, before))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` whose readers are done (written themselves)."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path is not None:
            _remove(t.sparkSession, path)


def hash_bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, those at the top bits of each ``h`` set; at most 2**bits / 64 rows reach the driver."""
    at = F.shiftrightunsigned("h", 64 - bits)
    rows = (hashes.groupBy(F.shiftrightunsigned(at, 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                          at.bitwiseAND(63).cast("int"))).alias("set")).toPandas())
    out = np.zeros(max(1, (1 << bits) // 64), dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["set"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be among those of the bitmap; none of them is missed."""
    bit = h >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


@contextmanager
def written_buckets(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the shared folder, bucketed by ``key``.

    Joins on ``key`` read it in place, so wide rows that several joins need
    are shuffled once, when written.  There are as many buckets as shuffle
    partitions.  The table goes with the block; use no frame that is not written
    by then.
    """
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    (df.write.format("parquet").option("parquet.block.size", ROW_GROUP).bucketBy(buckets, key)
     .option("path", path := f"{checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        _remove(spark, path)


def bounded_batches(spark: SparkSession, size: str = "2m") -> None:
    """From now on Arrow batches of about ``size`` bytes, unless the session sets a bound itself.

    For operators whose result is computed when the caller writes it: a batch
    of whole texts must not grow with the texts' lengths.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, size)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of about ``size`` bytes for the jobs run inside the block.

    A batch exists in the JVM, as Arrow data and as Python objects at once, in
    every running task, so whole texts want batches bound by bytes, not rows.
    The session's own setting is back after the block.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)

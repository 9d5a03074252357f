"""Driver tables (parquet) as DataFrames; Catalyst prunes columns at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Guarantee enough scan parallelism for CPU-heavy per-row work.

    A parquet file with one row group is read by a single task; text jobs on
    it would run on one core.  When the scan yields fewer partitions than the
    cluster's default parallelism, hash-repartition by ``key`` (deterministic
    under retries).  Large inputs already have many splits: no shuffle then.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key)

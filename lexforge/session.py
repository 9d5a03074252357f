"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # remove checkpoint files once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "lexforge",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it when unset.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; we only invent one (under /tmp) for local
    masters, i.e. tests and single-machine runs.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) before running lexforge jobs on a cluster")
        configured = tempfile.mkdtemp(prefix="lexforge-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


@contextmanager
def listing_tasks(spark):
    """Folders below are listed by four tasks a core at most, not by one task for each folder
    (up to 10,000), whose start takes far longer than its listing."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


ROW_GROUP = 16 << 20      # bytes that a writer of a scratch table holds


def written(df):
    """``df`` as a Parquet table of its own in the shared folder (cuts the lineage).

    The folder is the one ``spark.checkpoint.dir`` names, which every executor
    shares; a lost executor costs no more than re-reading the table.  Wide rows
    are packed by column and read by column, and are not cached besides.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(table) -> None:
    """Remove a table of :func:`written` whose readers are done."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def reliable_checkpoint(df):
    """Materialise ``df`` in the shared checkpoint folder (never localCheckpoint).

    Fixes partition membership and cuts lineage so later stages and retries
    see exactly the same rows per partition.
    """
    checkpoint_dir(df.sparkSession)
    # without a persisted input, writing the checkpoint files re-runs the
    # whole plan after the materialising job; the cache is dropped right after
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()

"""Run logs and checkpoint manifests as tables (survey C5, C6, F8, G2, G4, J1, J2, J4, J6, J7).

A run log has one row per training step.  All counters are running
aggregates per run computed by distributed scans, so one run holding a large
share of all steps is still split across many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.operators.positions import OrderedScan, ordered_running

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("step", T.LongType()),
    T.StructField("examples", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("weight_stats", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("grad_norms", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("is_checkpoint", T.BooleanType()),
    T.StructField("event_id", T.LongType()),
])

# Fixed values of the reference's defaults.
LOG_EVERY = 100          # log frequency (batches)
CHECKPOINT_EVERY = 1000  # checkpoint frequency (batches)
MAX_CHECKPOINTS = 5
D_MODEL = 512
WARMUP = 10000


def steps(log: DataFrame, run_col: str = "run", order=("ts", "event_id"),
          steps_per_epoch: int | None = None) -> DataFrame:
    """0-based ``step`` per run in time order (ties by event id) and, when
    ``steps_per_epoch`` is given, ``epoch = step // steps_per_epoch``."""
    out = ordered_running(log, [F.col(c) for c in order], [run_col], pos_col="step")
    if steps_per_epoch:
        out = out.withColumn("epoch", F.floor(F.col("step") / steps_per_epoch).cast("int"))
    return out


def progress(log: DataFrame, run_col: str = "run", order=("ts", "event_id"), examples_col: str = "examples",
             ckpt_col: str = "is_checkpoint", steps_per_epoch: int | None = None,
             gap_s: float | None = None) -> DataFrame:
    """G2 + G4 in one sort: per step, in ``order``, the counters of a run.

    ``step``; the totals before it (total_batches, total_examples) and, as a
    restarted run takes them from its last checkpoint, what came since its
    session began (session_*), and since the later of that and the last
    checkpoint before this step (checkpoint_*): batches, examples and seconds.
    A session ends where nothing was logged for ``gap_s`` seconds (None: never).
    With ``steps_per_epoch`` also epoch, and the counters *after* the step in the
    epoch and in all (G2)."""
    us = F.unix_micros(F.col(order[0]).cast("timestamp"))
    scan = OrderedScan(log.withColumn("_us", us), list(order), [run_col])
    scan.add(sums={"step": (F.lit(1).cast("long"), False), "total_examples": (examples_col, False)},
             latest={"_before": (F.lit(True), F.col("_us"), False)})
    at = F.struct(F.col("step").alias("b"), F.col("total_examples").alias("e"), F.col("_us").alias("us"))
    after = F.struct((F.col("step") + 1).alias("b"), (F.col("total_examples") + F.col(examples_col)).alias("e"),
                     F.col("_us").alias("us"))
    begins = F.col("_before").isNull()
    if gap_s is not None:
        begins = begins | (F.col("_us") - F.col("_before") > int(gap_s * 1_000_000))
    marks = {"_session": (begins, at, True), "_ckpt": (F.col(ckpt_col), after, False)}
    if steps_per_epoch:
        marks["_epoch"] = (F.col("step") % steps_per_epoch == 0, at, True)
    scan.add(sums={"session": (begins.cast("long"), True)}, latest=marks)
    out = scan.result().withColumn("_base", F.when(F.col("_ckpt.b") > F.col("_session.b"), F.col("_ckpt"))
                                   .otherwise(F.col("_session")))
    out = out.withColumn("session", F.col("session") - 1).withColumn("total_batches", F.col("step"))
    for name, base in (("session", "_session"), ("checkpoint", "_base")):
        out = out.withColumns({f"{name}_batches": F.col("step") - F.col(f"{base}.b"),
                               f"{name}_examples": F.col("total_examples") - F.col(f"{base}.e"),
                               f"{name}_s": (F.col("_us") - F.col(f"{base}.us")) / 1e6})
    if steps_per_epoch:
        out = out.withColumns({
            "epoch": F.floor(F.col("step") / steps_per_epoch).cast("int"),
            "global_batches": F.col("step") + 1, "global_examples": F.col("total_examples") + F.col(examples_col),
            "epoch_batches": F.col("step") - F.col("_epoch.b") + 1,
            "epoch_examples": F.col("total_examples") - F.col("_epoch.e") + F.col(examples_col)})
    return out.drop("_us", "_before", "_session", "_ckpt", "_base", "_epoch")


def session_throughput(steps_in_sessions: DataFrame, run_col: str = "run", ts_col: str = "ts",
                       examples_col: str = "examples") -> DataFrame:
    """F8 over sessions: for each session of :func:`progress`, its own batches, examples, seconds and
    rates, and the totals with all sessions before it (a pause between two is no training time)."""
    t = steps_in_sessions.withColumn("_us", F.unix_micros(F.col(ts_col).cast("timestamp")))
    own = t.groupBy(run_col, "session").agg(
        F.count(F.lit(1)).alias("session_batches"), F.sum(examples_col).alias("session_examples"),
        ((F.max("_us") - F.min("_us")) / 1e6).alias("session_s"))
    # one row a session: sessions of a run, not its steps
    so_far = Window.partitionBy(run_col).orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in ("batches", "examples", "s"):
        own = own.withColumn(f"total_{c}", F.sum(f"session_{c}").over(so_far))
    for scope in ("session", "total"):
        b, e, el = (F.col(f"{scope}_{c}") for c in ("batches", "examples", "s"))
        own = own.withColumns({f"{scope}_examples_per_s": F.try_divide(e, el).cast("long"), f"{scope}_s_per_batch": el / b})
    return own


def log_due(log: DataFrame, every: int = LOG_EVERY, step_col: str = "step") -> DataFrame:
    """Steps whose counter (before the increment) is a multiple of ``every``."""
    return log.where(F.col(step_col) % every == 0)


def checkpoint_due(log: DataFrame, every: int = CHECKPOINT_EVERY, last: int = 0,
                   step_col: str = "step") -> DataFrame:
    """The counter *after* the increment is a multiple of ``every`` and
    beyond the last checkpoint."""
    after = F.col(step_col) + 1
    return log.where((after % every == 0) & (after > last))


def learning_rate(step, d_model: int = D_MODEL, warmup: int = WARMUP, scale: float = 1.0):
    """Inverse-square-root schedule with linear warm-up."""
    s = (F.col(step) if isinstance(step, str) else step) + 1
    return F.lit(scale) * F.pow(F.lit(float(d_model)), -0.5) * F.least(
        F.pow(s, -0.5), s * F.pow(F.lit(float(warmup)), -1.5))


def throughput(log: DataFrame, run_col: str = "run", ts_col: str = "ts", step_col: str = "step",
               examples_col: str = "examples", ckpt_col: str = "is_checkpoint") -> DataFrame:
    """F8: per run, batches/s, examples/s (integer-truncated) and s/batch for the
    session, in total and since the last checkpoint (the session's start where
    there is none).  Here the log is one session, so its total is the session's;
    :func:`session_throughput` tells sessions apart.
    Every run has a row of each scope; without a batch, s/batch is 0.

    Two grouped aggregations (map-side combined): the run totals with the last
    checkpoint's step and time, then the rows after that step."""
    t = log.withColumn("_us", F.unix_micros(F.col(ts_col).cast("timestamp")))
    last = F.max(F.when(F.col(ckpt_col), F.struct(F.col(step_col).alias("step"), F.col("_us").alias("us"))))
    runs = t.groupBy(run_col).agg(
        F.min("_us").alias("_t0"), F.max("_us").alias("_t1"), last.alias("_ck"),
        F.count(F.lit(1)).alias("batches"), F.sum(examples_col).alias("n_examples"))
    runs = runs.withColumns({"_step": F.coalesce(F.col("_ck.step"), F.lit(-1)),
                             "_begin": F.coalesce(F.col("_ck.us"), F.col("_t0"))})
    later = F.col(step_col) > F.col("_step")
    after = (t.select(run_col, step_col, examples_col)
             .join(runs.select(run_col, "_step", "_begin", F.col("_t1").alias("_end")), run_col)
             .groupBy(run_col).agg(F.count(F.when(later, 1)).alias("batches"),
                                   F.coalesce(F.sum(F.when(later, F.col(examples_col))), F.lit(0)).alias("n_examples"),
                                   F.max("_end").alias("_end"), F.max("_begin").alias("_begin")))

    def rates(df, name):
        el = (F.col("_end") - F.col("_begin")) / 1e6
        return df.select(run_col, F.lit(name).alias("scope"), "batches", "n_examples",
                         el.alias("elapsed_s"),
                         F.try_divide(F.col("batches"), el).alias("batches_per_s"),
                         F.try_divide(F.col("n_examples"), el).cast("long").alias("examples_per_s"),
                         F.when(F.col("batches") == 0, F.lit(0.0)).otherwise(el / F.col("batches")).alias("s_per_batch"))
    session = runs.select(run_col, "batches", "n_examples", F.col("_t1").alias("_end"),
                          F.col("_t0").alias("_begin"))
    return (rates(session, "session").unionByName(rates(session, "total"))
            .unionByName(rates(after, "since_checkpoint")))


CKPT_NAME_RE = r"^(?:(.*)/)?([^/]+)_epoch(\d+)_batch(\d+)\.pt$"
EPOCH_DIR_RE = r"(^|/)epoch/[^/]+$"


def checkpoint_name(run, epoch, batch) -> F.Column:
    """``{run}_epoch{e}_batch{b}.pt``."""
    return F.format_string("%s_epoch%d_batch%d.pt", run, epoch, batch)


def parse_checkpoint_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Run, epoch, batch and kind (``epoch`` files sit in an ``epoch``
    sub-folder) from listed checkpoint paths."""
    p = F.col(path_col)
    return paths.select(
        "*",
        F.regexp_extract(p, CKPT_NAME_RE, 2).alias("ckpt_run"),
        F.regexp_extract(p, CKPT_NAME_RE, 3).cast("int").alias("ckpt_epoch"),
        F.regexp_extract(p, CKPT_NAME_RE, 4).cast("long").alias("ckpt_batch"),
        F.when(p.rlike(EPOCH_DIR_RE), F.lit("epoch")).otherwise(F.lit("step")).alias("kind"))


def resume_point(manifest: DataFrame, run_col: str = "ckpt_run") -> DataFrame:
    """The latest checkpoint per run by (epoch, batch) - its counters
    become the new session's baselines."""
    key = F.struct(F.col("ckpt_epoch"), F.col("ckpt_batch"), F.col("path"))
    best = manifest.groupBy(run_col).agg(F.max(key).alias("_b"))
    return best.select(run_col, F.col("_b.path").alias("path"),
                       F.col("_b.ckpt_epoch").alias("epoch"), F.col("_b.ckpt_batch").alias("batch"))


def retention(manifest: DataFrame, max_checkpoints: int | None = MAX_CHECKPOINTS,
              dir_col: str = "ckpt_run", ctime_col: str = "ctime") -> DataFrame:
    """``keep``/``expire`` flag per checkpoint file - only the newest
    ``max`` files by ctime survive; ``None`` keeps all.  Never deletes."""
    if max_checkpoints is None:
        return manifest.withColumn("action", F.lit("keep"))
    r = ordered_running(manifest, [F.col(ctime_col).desc(), F.col("path").desc()], [dir_col],
                        pos_col="_age_rank")
    return r.withColumn("action", F.when(F.col("_age_rank") < max_checkpoints, "keep")
                        .otherwise("expire")).drop("_age_rank")

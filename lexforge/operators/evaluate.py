"""Loss and statistics on prediction / vector tables (survey I1-I3, F6, F7).

Per-row work is array arithmetic (``aggregate``/``transform``); the mean is
an ordinary ``avg`` with map-side partial aggregation, so any number of
prediction rows reduces in one shuffle of one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_double(logits) -> Column:
    c = F.col(logits) if isinstance(logits, str) else logits
    return F.transform(c, lambda x: x.cast("double"))


def row_cross_entropy(logits, label) -> Column:
    """``logsumexp(l) - l[label]`` with the max shift (no overflow), in one pass:
    the accumulator holds the running maximum and the sum scaled to it."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    low = F.lit(float("-inf"))
    start = F.struct(low.alias("m"), F.lit(0.0).alias("s"))

    def add(acc, v):
        x = v.cast("double")
        bigger = F.struct(x.alias("m"), (acc["s"] * F.exp(acc["m"] - x) + 1.0).alias("s"))
        same = F.struct(acc["m"].alias("m"), (acc["s"] + F.exp(x - acc["m"])).alias("s"))
        return F.when(x == low, acc).when(x > acc["m"], bigger).otherwise(same)
    total = F.aggregate(lg, start, add, lambda acc: acc["m"] + F.log(acc["s"]))
    lab = F.col(label) if isinstance(label, str) else label
    return total - F.element_at(lg, lab + 1).cast("double")


def row_nll(logits, label) -> Column:
    """I2 per row: explicit softmax, then ``-ln p[label]`` (no shift inside
    the log, so a vanishing probability gives +inf)."""
    lg = _as_double(logits)
    lab = F.col(label) if isinstance(label, str) else label
    p = F.exp(F.element_at(lg, lab + 1)) / F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x))
    return -F.log(p)


def masked_cross_entropy(pred: DataFrame, logits: str = "logits", label: str = "label",
                         selected: str | None = "selected", group: Sequence[str] = ()) -> DataFrame:
    """I1 + I3: mean cross-entropy over selected positions, and
    ``probability = exp(-loss)``.  No selected row -> NULL (torch: NaN)."""
    df = pred.where(F.col(selected)) if selected else pred
    loss = F.avg(row_cross_entropy(logits, label))
    out = df.groupBy(*group).agg(loss.alias("cross_entropy"), F.count(F.lit(1)).alias("n_scored"))
    return out.withColumn("probability", F.exp(-F.col("cross_entropy")))


def masked_nll(pred: DataFrame, logits: str = "logits", label: str = "label",
               selected: str | None = "selected", group: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-likelihood over selected positions."""
    df = pred.where(F.col(selected)) if selected else pred
    return df.groupBy(*group).agg(F.avg(row_nll(logits, label)).alias("nll"))


def vector_stats(df: DataFrame, name_col: str, values: str,
                 prefixes: Sequence[str] | None = None) -> DataFrame:
    """per name - mean, sample std (unbiased, like torch ``std()``) and L2
    norm of all elements, optionally restricted to names with given prefixes."""
    if prefixes:
        cond = None
        for p in prefixes:
            c = F.col(name_col).startswith(p)
            cond = c if cond is None else (cond | c)
        df = df.where(cond)
    x = df.select(name_col, F.explode(_as_double(values)).alias("x"))
    return x.groupBy(name_col).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
                                   F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l2_norm"))


def nan_audit(df: DataFrame, name_col: str, values: str) -> DataFrame:
    """per name - NaN count, element count, NaN ratio and any-NaN flag."""
    per_row = df.select(
        name_col,
        F.aggregate(F.col(values), F.lit(0).cast("long"),
                    lambda acc, v: acc + F.when(F.isnan(v), 1).otherwise(0)).alias("_nan"),
        F.size(values).cast("long").alias("_n"))
    return (per_row.groupBy(name_col)
            .agg(F.sum("_nan").alias("n_nan"), F.sum("_n").alias("n_total"))
            .withColumn("nan_ratio", F.try_divide(F.col("n_nan"), F.col("n_total")))
            .withColumn("has_nan", F.col("n_nan") > 0))

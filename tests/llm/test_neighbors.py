"""Probes chosen by a sample, their share of all pairs as tables grow, and repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import neighbors


def table(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def needed(spark, df, recall=0.95):
    items = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    top = float(np.sqrt(max((sum(x * x for x in r.vec) for r in items.collect()), default=1.0)))
    placed = items.withColumn("cells", neighbors._cells_udf(12, 1, 32, top, 3)("vec"))
    return neighbors.probes_needed(placed, items.where("id % 20 = 0"), 20, 12, 32, recall, 64, 3)


def test_fewer_probes_on_larger_tables(spark):
    few, reached = needed(spark, table(spark, 8000)[1])
    many, _ = needed(spark, table(spark, 300)[1])
    assert few < many and reached >= 0.95
    assert needed(spark, table(spark, 300)[1], 1.0)[1] == 1.0
    assert needed(spark, table(spark, 0)[1]) == (1, 1.0)


def test_recall_with_chosen_probes(spark):
    x, df = table(spark, 1500, 1)
    got = {}
    for r in neighbors.nearest(df, df.where("vec_id % 20 = 0"), k=10, sample=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {int(v) for v in np.argsort(-(x @ x[q]) + 1e9 * (np.arange(1500) == q))[:10]}) for q in got)
    assert len(got) == 75 and hits >= 0.93 * 750


@pytest.mark.parametrize("copies", [1, 60])
def test_repeated_ids_are_one_candidate(spark, copies):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 8))
    rows = [(i, v.tolist(), 1, "s") for i, v in enumerate(x)] + [(7, (x[7] * s).tolist(), 1, "s") for s in
                                                            np.linspace(0.5, 2, copies)] + [(0, x[0].tolist(), 1, "s")] * copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    found = [r for r in neighbors.nearest(df, df.where("vec_id = 0"), k=20).collect()]
    best = {}
    for i, v, *_ in rows:
        if i:
            best[i] = max(best.get(i, -9e9), float(x[0] @ np.array(v)))
    want = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:20]
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [i for i, _ in want]
    assert [r.score for r in sorted(found, key=lambda r: r["rank"])] == pytest.approx([s for _, s in want])

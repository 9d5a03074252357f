"""Distributed positions / running totals vs brute force, with a hot group."""

import random

import pandas as pd
from pyspark.sql import functions as F

from lexforge.functions.hashing import hash_key
from lexforge.operators.positions import OrderedScan, hash_order_positions, ordered_running
from lexforge.operators.runlog import progress, session_throughput


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if i % 3 == 0 else rnd.randint(1, 20)       # group 0 holds a third of the rows
        rows.append((i, g, rnd.randint(0, 50), rnd.randint(1, 9), rnd.random() < 0.2))
    return spark.createDataFrame(rows, "id long, g long, k long, w long, flag boolean")


def test_ordered_running_matches_bruteforce(spark):
    df = _data(spark).repartition(6)
    got = ordered_running(df, [F.col("k").desc(), F.col("id")], ["g"], pos_col="pos",
                          sums={"w_before": "w"},
                          maxes={"last_flag_id": F.when(F.col("flag"), F.col("id"))}).toPandas()
    pdf = df.toPandas().sort_values(["g", "k", "id"], ascending=[True, False, True])
    pdf["pos"] = pdf.groupby("g").cumcount()
    pdf["w_before"] = pdf.groupby("g")["w"].cumsum() - pdf["w"]
    pdf["fid"] = pdf["id"].where(pdf["flag"])
    pdf["last_flag_id"] = pdf.groupby("g")["fid"].transform(lambda s: s.shift(1).cummax().ffill())
    m = got.merge(pdf, on="id", suffixes=("", "_exp"))
    assert len(m) == 3000
    assert (m["pos"] == m["pos_exp"]).all()
    assert (m["w_before"] == m["w_before_exp"]).all()
    a, b = m["last_flag_id"], m["last_flag_id_exp"]
    assert ((a == b) | (a.isna() & b.isna())).all()


def test_ordered_running_global_and_small_path(spark):
    df = _data(spark)
    big = ordered_running(df, [F.col("id")], pos_col="pos", sums={"s": "w"}).toPandas()
    small = ordered_running(df, [F.col("id")], pos_col="pos", sums={"s": "w"}, small=True).toPandas()
    for got in (big, small):
        got = got.sort_values("id")
        assert list(got["pos"]) == list(range(3000))
        assert list(got["s"]) == list(got["w"].cumsum() - got["w"])


def test_hash_order_positions(spark):
    df = _data(spark).withColumn("h", hash_key(3, "id"))
    got = hash_order_positions(df, "h", "id", partition=["g"], digits=2).toPandas()
    exp = df.toPandas().sort_values(["g", "h", "id"])
    exp["pos"] = exp.groupby("g").cumcount()
    m = got.merge(exp[["id", "pos"]], on="id", suffixes=("", "_exp"))
    assert (m["pos"] == m["pos_exp"]).all()


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, w long")
    assert ordered_running(df, [F.col("id")], sums={"s": "w"}).count() == 0
    assert hash_order_positions(df.withColumn("h", hash_key(1, "id")), "h", "id").count() == 0


def test_ordered_scan_levels_and_null_group(spark):
    df = _data(spark, 1500).withColumn("g", F.when(F.col("g") != 3, F.col("g"))).repartition(6)
    scan = OrderedScan(df, ["k", "id"], ["g"])
    scan.add(sums={"pos": (F.lit(1).cast("long"), False), "upto": ("w", True)},
             latest={"prev": (F.lit(True), F.struct("k", "id"), False)})
    scan.add(latest={"tenth": (F.col("pos") % 10 == 0, F.col("pos"), True),
                     "flagged": (F.col("flag"), F.col("upto"), False)})
    got = {r.id: r for r in scan.result().collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r)
    assert None in groups and len(got) == 1500
    for rows in groups.values():
        upto, prev, flagged = 0, None, None
        for pos, r in enumerate(sorted(rows, key=lambda r: (r.k, r.id))):
            upto += r.w
            x = got[r.id]
            assert (x.pos, x.upto, x.tenth, x.flagged) == (pos, upto, pos // 10 * 10, flagged)
            assert (tuple(x.prev) if x.prev else None) == prev
            prev = (r.k, r.id)
            flagged = upto if r.flag else flagged
    empty = OrderedScan(df.where("false"), ["k"], ["g"]).add(sums={"n": (F.lit(1), True)}).result()
    assert empty.count() == 0


def test_progress_over_sessions(spark):
    import datetime as dt
    rnd = random.Random(2)
    rows, t = [], dt.datetime(2024, 1, 1)
    for i in range(400):
        t += dt.timedelta(seconds=rnd.choice([1, 2, 5, 5000]) if rnd.random() < 0.1 else 1)
        rows.append((f"r{i % 2}", i, t, rnd.random() < 0.05, rnd.randint(1, 9)))
    df = spark.createDataFrame(rows, "run string, event_id long, ts timestamp, is_checkpoint boolean, examples long").repartition(5)
    out = progress(df, steps_per_epoch=30, gap_s=1000)
    got = {r.event_id: r for r in out.collect()}
    ends = {(r.run, r.session): r for r in session_throughput(out).collect()}
    restarts = 0
    for run in ("r0", "r1"):
        step = total = elapsed = 0
        session, before, epoch = -1, None, 0
        for _, i, ts, ck, ex in [r for r in rows if r[0] == run]:
            if before is None or (ts - before).total_seconds() > 1000:
                session, begin = session + 1, (step, total, ts)
                base = begin
            if step % 30 == 0:
                epoch = total
            r = got[i]
            assert (r.step, r.session, r.total_examples, r.epoch) == (step, session, total, step // 30)
            assert (r.session_batches, r.session_examples, r.session_s) == (
                step - begin[0], total - begin[1], (ts - begin[2]).total_seconds())
            assert (r.checkpoint_batches, r.checkpoint_examples, r.checkpoint_s) == (
                step - base[0], total - base[1], (ts - base[2]).total_seconds())
            assert (r.epoch_batches, r.epoch_examples) == (step % 30 + 1, total - epoch + ex)
            step, total, before = step + 1, total + ex, ts
            if ck:
                base = (step, total, ts)
            end = ends[run, session]
        restarts += session
        assert (end.total_batches, end.total_examples) == (step, total) and end.session_batches < step
    assert restarts > 4


def test_selection_without_ranking(spark, monkeypatch):
    from lexforge.operators import sampling
    rnd = random.Random(6)
    ids = [rnd.randrange(-500, 5000) for _ in range(2000)]
    df = spark.createDataFrame([(i, "t") for i in ids] + [(None, "t")] * 3, "doc_id long, text string").repartition(4)
    for refine in (1_000_000, 50):
        monkeypatch.setattr(sampling, "REFINE", refine)
        for n in (0, 1, 17, 1000, 2000, 2002, 5000):
            got = sorted((r.doc_id for r in sampling.first_rows(df, "doc_id", n, bins=8).collect()), key=lambda x: (x is None, x))
            last = sorted(ids)[n - 1] if 0 < n <= 2000 else None
            want = sorted(i for i in ids if i <= last) if last is not None else [] if n == 0 else sorted(ids) + [None] * 3
            assert got == want, (refine, n)
        uniq = df.where("doc_id is not null").dropDuplicates(["doc_id"])
        keyed = uniq.withColumn("h", hash_key(4, "doc_id"))
        order = [r.doc_id for r in keyed.orderBy("h", "doc_id").collect()]
        for n in (1, 40, len(order) - 1, len(order), len(order) + 9):
            assert sorted(r.doc_id for r in sampling.hash_cut(keyed, "h", ["doc_id"], n, 1).collect()) == sorted(order[:n])
        got = sampling.exact_sample(uniq, "doc_id", 30, 4).orderBy("sample_pos").collect()
        assert [r.doc_id for r in got] == order[:30]
    assert sampling.first_rows(df.where("false"), "doc_id", 5).count() == 0
    assert sampling.exact_sample(df.where("false"), "doc_id", 5, 1).count() == 0


def test_positions_move_the_rows_once(spark):
    """The rows are sorted by range; their places in the sorted partitions are no reason to shuffle them again."""
    rows = [(g, i) for g in (None, 0, 1, 2) for i in range(0 if g == 2 else 200)]
    df = spark.createDataFrame(rows, "g int, i int").repartition(5)
    whole = ordered_running(df, ["g", "i"])
    assert "Window" not in whole.select("g", "i", "pos")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.g, r.i) for r in whole.orderBy("pos").collect()] == want
    assert sorted(r.pos for r in whole.collect()) == list(range(600))
    each = ordered_running(df.where("g IS NOT NULL"), ["i"], ["g"], pos_col="at")
    assert {(r.g, r.i): r["at"] for r in each.collect()} == {(g, i): i for g, i in rows if g is not None}

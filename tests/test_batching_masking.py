"""Batching edges, masking properties, loss edges, run-log retention."""

import math

import pytest
from pyspark.sql import functions as F

from lexforge.operators import batching, evaluate, masking, runlog


def _tokens(spark, sizes, seq=4):
    rows, ex = [], 0
    for f, n in enumerate(sizes):
        for r in range(n):
            rows.append((f"f{f}", r, ex, [ex % 7 + 3] * seq))
            ex += 1
    return spark.createDataFrame(rows, "rel_path string, row long, example_id long, ids array<int>")


@pytest.mark.parametrize("sizes,b", [([], 4), ([3], 4), ([4], 4), ([5], 4), ([2, 3, 3], 4), ([3, 0, 6], 4)])
def test_batches_drop_and_keep(spark, sizes, b):
    n = sum(sizes)
    t = _tokens(spark, [s for s in sizes if s])
    pos = batching.epoch_positions(t, 1, seed=5)
    for drop in (True, False):
        got = batching.assign_batches(pos, b, drop_last=drop).collect()
        expect_rows = (n // b) * b if drop else n
        assert len(got) == expect_rows
        assert len({r.example_id for r in got}) == expect_rows          # each row at most once
        per = {}
        for r in got:
            per.setdefault(r.batch_id, []).append(r.batch_pos)
        for bid, ps in per.items():
            assert sorted(ps) == list(range(len(ps)))
            if drop or bid < n // b:
                assert len(ps) == b


def test_file_order_carries_across_files(spark):
    t = _tokens(spark, [3, 3, 3])
    pos = batching.epoch_positions(t, 2, seed=1, shuffle_contents=False).toPandas()
    for _, g in pos.groupby("epoch"):
        assert sorted(g["pos"]) == list(range(9))
        # files stay contiguous, rows in file order when not shuffled
        g = g.sort_values("pos")
        assert all((g["rel_path"].iloc[i] == g["rel_path"].iloc[i + 1]) or g["row"].iloc[i + 1] == 0
                   for i in range(8))


def test_drop_all_pad_and_counters(spark):
    rows = [(0, 0, [1, 1]), (0, 1, [5, 1]), (0, 2, [1, 1]), (1, 0, [4, 4])]
    b = spark.createDataFrame(rows, "batch_id long, batch_pos int, ids array<int>").withColumn("epoch", F.lit(0))
    assert batching.drop_all_pad(b).count() == 2
    c = {r.batch_id: r for r in batching.batch_counters(b.withColumn("example_id", F.lit(1))).collect()}
    assert (c[0].n_examples, c[0].global_examples, c[1].global_batches, c[1].global_examples) == (3, 3, 2, 4)


def test_missing_files(spark):
    m = spark.createDataFrame([("a",), ("b",)], "rel_path string")
    listing = spark.createDataFrame([("a",)], "rel_path string")
    assert [r.rel_path for r in batching.missing_files(m, listing).collect()] == ["b"]
    with pytest.raises(FileNotFoundError):
        batching.require_files(m, listing)


def _batch(spark, n=400, seq=32):
    rows = [(0, i, [1 if j >= (i % seq) + 1 else 10 + j for j in range(seq)]) for i in range(n)]
    return spark.createDataFrame(rows, "epoch int, example_id long, ids array<int>")


def test_mask_properties(spark):
    b = _batch(spark)
    cfg = masking.MaskConfig(mask_prob=0.3, vocab_high=100, seed=3)
    m = masking.mask_batches(b, cfg).collect()
    sel = tot = 0
    for r in m:
        for x, mx, s, a in zip(r.ids, r.masked_ids, r.selected, r.attention_mask):
            assert a == (0 if x == 1 else 1)
            if x == 1:
                assert not s and mx == 1                      # pads never selected
            if not s:
                assert mx == x                                # unselected unchanged
            else:
                assert mx in (2, x) or 5 <= mx < 100
            sel += s
            tot += x != 1
    p = sel / tot
    assert abs(p - 0.3) < 4 * math.sqrt(0.3 * 0.7 / tot)
    again = masking.mask_batches(b.repartition(7), cfg).collect()   # deterministic under repartition
    assert sorted((r.example_id, r.masked_ids) for r in again) == sorted((r.example_id, r.masked_ids) for r in m)


@pytest.mark.parametrize("p,pm,pr", [(0.0, 0.8, 0.1), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.8, 0.1), (1.0, 0.5, 0.5)])
def test_mask_proportions(spark, p, pm, pr):
    b = _batch(spark, 200)
    m = masking.mask_batches(b, masking.MaskConfig(mask_prob=p, prop_mask=pm, prop_random=pr, vocab_high=50)).collect()
    cells = [(x, mx, s) for r in m for x, mx, s in zip(r.ids, r.masked_ids, r.selected) if x != 1]
    if p == 0:
        assert not any(s for _, _, s in cells)
    else:
        assert all(s for _, _, s in cells)
        frac_mask = sum(mx == 2 for _, mx, _ in cells) / len(cells)
        assert abs(frac_mask - pm) < 0.06
        if pm == 0 and pr == 0:
            assert all(mx == x for x, mx, _ in cells)


def test_mask_config_validation():
    with pytest.raises(ValueError):
        masking.MaskConfig(mask_prob=1.5).validate()
    with pytest.raises(ValueError):
        masking.MaskConfig(prop_mask=0.8, prop_random=0.3).validate()


def test_cross_entropy_edges(spark):
    rows = [(0, [1000.0, 0.0, -1000.0], 0, True), (1, [0.0, 0.0], 1, True), (2, [5.0, 1.0], 0, False)]
    df = spark.createDataFrame(rows, "id long, logits array<double>, label int, selected boolean")
    r = evaluate.masked_cross_entropy(df).first()
    assert r.n_scored == 2 and abs(r.cross_entropy - math.log(2) / 2) < 1e-9    # no overflow
    none = evaluate.masked_cross_entropy(df.where("not selected"), selected="selected").first()
    assert none.cross_entropy is None and none.n_scored == 0
    nan = evaluate.nan_audit(spark.createDataFrame([("w", [float("nan"), 1.0])], "name string, v array<double>"),
                             "name", "v").first()
    assert (nan.n_nan, nan.n_total, nan.has_nan) == (1, 2, True)


@pytest.mark.parametrize("mx,expect_keep", [(None, 4), (1, 1), (10, 4), (2, 2)])
def test_retention(spark, mx, expect_keep):
    rows = [("ckpt/r_epoch0_batch%d.pt" % i, "r", 0, i, i // 2) for i in range(4)]  # equal ctimes in pairs
    man = spark.createDataFrame(rows, "path string, ckpt_run string, ckpt_epoch int, ckpt_batch long, ctime long")
    got = runlog.retention(man, mx).collect()
    kept = sorted(r.path for r in got if r.action == "keep")
    assert len(kept) == expect_keep
    if mx == 1:
        assert kept == ["ckpt/r_epoch0_batch3.pt"]


def test_checkpoint_paths_and_resume(spark):
    paths = ["c/run_a_epoch0_batch20.pt", "c/epoch/run_a_epoch1_batch0.pt", "c/run_a_epoch1_batch5.pt"]
    m = runlog.parse_checkpoint_paths(spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {r.path: (r.ckpt_run, r.ckpt_epoch, r.ckpt_batch, r.kind) for r in m.collect()}
    assert got[paths[1]] == ("run_a", 1, 0, "epoch") and got[paths[0]] == ("run_a", 0, 20, "step")
    assert runlog.resume_point(m).first().path == paths[2]


def test_validate_tokens_edges(spark):
    from lexforge.operators import encode
    rows = [(0, [1, 1, 1, 1]), (1, [5, 6, 7, 8]), (2, [3, 1, 1, 1]), (3, [1, 2, 3]), (4, [-1, 3, 3, 3]),
            (5, [3, 3, 3, 99]), (6, [100, 1])]
    df = spark.createDataFrame(rows, "example_id long, ids array<int>")
    got = {r.example_id: r.reason for r in encode.validate_tokens(df, 4, 99).collect()}
    assert got == {3: "width", 4: "id_range", 5: "id_range", 6: "width,id_range"}


def test_truncate_pad_decode(spark):
    from lexforge.operators import encode
    vocab = spark.createDataFrame([(0, "[UNK]"), (1, "[PAD]"), (2, "[MASK]"), (3, "ab</w>"), (4, "c"), (5, "d</w>")],
                                  "token_id int, piece string")
    df = spark.createDataFrame([([3, 4, 5, 0],), ([],), ([4, 5, 3, 3, 3, 3],)], "ids array<int>")
    r = df.select(encode.fixed_length(F.col("ids"), 4).alias("f"),
                  encode.decode(F.col("ids"), encode.id_lookup(vocab)).alias("t")).collect()
    assert [x.f for x in r] == [[3, 4, 5, 0], [1, 1, 1, 1], [4, 5, 3, 3]]
    assert [x.t for x in r] == ["ab cd", "", "cd ab ab ab ab"]


def test_validation_reports_nulls(spark):
    from lexforge.operators.encode import validate_tokens
    df = spark.createDataFrame([(0, [1, 2]), (1, None), (2, [1, None]), (3, [1]), (4, [1, 9])], "i int, ids array<int>")
    got = {r.i: r.reason for r in validate_tokens(df, 2, 5).collect()}
    assert got == {1: "width", 2: "id_range", 3: "width", 4: "id_range"}


def test_cross_entropy_any_order_and_selection(spark):
    import math
    from lexforge.operators.evaluate import masked_cross_entropy
    rows = [([1000.0, 0.0, 999.0], 2, True), ([0.0, 5.0, -3.0], 1, True), ([float("-inf"), 2.0, 1.0], 2, True),
            ([9.0, 9.0, 9.0], 0, False)]
    df = spark.createDataFrame(rows, "logits array<double>, label int, selected boolean")
    want = [1 + math.log1p(math.exp(-1)), math.log(1 + math.exp(-5) + math.exp(-8)), 1 + math.log1p(math.exp(-1))]
    got = masked_cross_entropy(df).first()
    assert got.n_scored == 3 and abs(got.cross_entropy - sum(want) / 3) < 1e-12


def test_throughput_has_every_scope(spark):
    from lexforge.operators.runlog import throughput
    rows = [("a", 0, 0, False), ("a", 1, 10, True), ("a", 2, 10, False), ("b", 0, 0, False), ("b", 1, 4, False),
            ("c", 0, 0, False), ("c", 1, 5, True)]
    df = spark.createDataFrame(rows, "run string, step long, s long, is_checkpoint boolean").selectExpr(
        "run", "step", "timestamp_seconds(s) ts", "8L examples", "is_checkpoint")
    got = {(r.run, r.scope): (r.batches, r.n_examples, r.elapsed_s, r.s_per_batch) for r in throughput(df).collect()}
    assert len(got) == 9 and got["a", "since_checkpoint"] == (1, 8, 0.0, 0.0)
    assert got["b", "since_checkpoint"] == got["b", "session"] == got["b", "total"] == (2, 16, 4.0, 2.0)
    assert got["c", "since_checkpoint"] == (0, 0, 0.0, 0.0)


def _one_file_at_a_time(sizes, batch_size):
    """Batches (file, sizes of the batch's parts) of a loader that reads file by file."""
    out, left = [], []
    for f, n in enumerate(sizes):
        rows = left + [(f, r) for r in range(n)]
        cut = len(rows) // batch_size * batch_size
        out += [(f, rows[i:i + batch_size]) for i in range(0, cut, batch_size)]
        left = rows[cut:]
        if not cut and left:
            out.append((f, left))
            left = []
    return out + ([(len(sizes), left)] if left else [])


@pytest.mark.parametrize("batch_size, chunk", [(1, 3), (7, 4), (10, 1), (64, 1000)])
def test_loader_batches_file_by_file(spark, monkeypatch, batch_size, chunk):
    import random
    monkeypatch.setattr(batching, "FILES_PER_CHUNK", chunk)
    rnd = random.Random(batch_size)
    sizes = [rnd.choice([1, 2, 3, 7, 9, 10, 25, 80]) for _ in range(30)]
    manifest = spark.createDataFrame([(f"f{i}", n, i) for i, n in enumerate(sizes)], "rel_path string, n_rows long, file_rank long")
    rows = spark.createDataFrame([(f"f{i}", r) for i, n in enumerate(sizes) for r in range(n)], "rel_path string, rank_in_file long")
    files = batching.loader_files(manifest.repartition(4), batch_size)
    want = _one_file_at_a_time(sizes, batch_size)
    got = {(r.rel_path, r.rank_in_file): (r.batch_id, r.batch_pos) for r in batching.loader_batches(rows, files, batch_size).collect()}
    assert got == {(f"f{f}", r): (b, p) for b, (_, batch) in enumerate(want) for p, (f, r) in enumerate(batch)}
    counters = {r.batch_id: (r.file_idx, r.file_batches, r.file_examples, r.n_examples)
                for r in batching.file_counters(files, batch_size).collect()}
    expect, batches, examples, now = {}, 0, 0, None
    for b, (f, batch) in enumerate(want):
        if f != now and f < len(sizes):
            batches, examples = 0, 0
        now = f
        batches, examples = batches + 1, examples + len(batch)
        expect[b] = (f, batches, examples, len(batch))
    assert counters == expect
    none = batching.loader_files(manifest.where("false"), batch_size)
    assert batching.file_counters(none, batch_size).count() == 0


def _digests(df):
    """How many md5 calls the plan of ``df`` makes for each row with an id array, cell by cell."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("md5(")


def _plain_mask(r, cfg):
    """Masked ids and selection of one row, cell by cell, as the module says."""
    import hashlib
    masked, selected = [], []
    for i, x in enumerate(r.ids):
        h = hashlib.md5(f"{cfg.seed}:{r.epoch}:{r.example_id}:{i}".encode()).hexdigest()
        u = [int(h[8 * k:8 * k + 8], 16) / 2 ** 32 for k in range(4)]
        on = x != cfg.pad_id and u[0] < cfg.mask_prob
        random = cfg.prop_random > 0 and cfg.prop_mask < 1 and u[2] < cfg.prop_random / (1 - cfg.prop_mask)
        selected.append(on)
        masked.append(x if not on else cfg.mask_id if u[1] < cfg.prop_mask else
                      cfg.vocab_low + int(u[3] * (cfg.vocab_high - cfg.vocab_low)) if random else x)
    return masked, selected, [int(x != cfg.pad_id) for x in r.ids]


@pytest.mark.parametrize("p,pm,pr,digests", [(0.15, 0.8, 0.1, 1), (0.5, 1.0, 0.0, 1), (0.5, 0.5, 0.5, 1), (0.15, 0.0, 0.0, 1),
                                             (1.0, 0.0, 0.0, 0), (0.0, 0.8, 0.1, 0), (1.0, 1.0, 0.0, 0), (1.0, 0.5, 0.25, 1)])
def test_masks_without_needless_digests(spark, p, pm, pr, digests):
    rows = [(0, e, [5 + (e * 7 + i) % 40 if i < e % 9 else 1 for i in range(8)]) for e in range(300)]
    df = spark.createDataFrame(rows, "epoch int, example_id long, ids array<int>")
    cfg = masking.MaskConfig(mask_prob=p, prop_mask=pm, prop_random=pr, vocab_high=50, seed=4)
    got = masking.mask_batches(df, cfg)
    for r in got.collect():
        assert (r.masked_ids, r.selected, r.attention_mask) == _plain_mask(r, cfg)
    assert _digests(got) == digests

"""Phrase collocations against brute force."""

import gc
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexforge.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words, min_count, percent, scale, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    kept = {}
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    for (lang, p), a in cand.items():
        inside = any(la == lang and len(q) > len(p) and 100 * b >= percent * a
                     and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (la, q), b in cand.items())
        if not inside:
            cuts = [(scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, c in kept.items()
            for i, (s, a, p, l, r) in enumerate(sorted(c)[:top])}


def rows(seed=0, n=150):
    rng = random.Random(seed)
    vocab = ["a", "B", "é", "c\x01", "c", "\x85x", " ", "dd", "a\x00", "日本"]
    sep = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", ": "]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(vocab) + rng.choice(sep) for _ in range(rng.choice([0, 1, 2, 5, 40, 120])))
        out.append((rng.choice(["en", "en", "und", None, "Ω", ""]), t))
    out += [("en", "fixed phrase of four. " * 50), ("fr", "x y " * 3000), ("en", None), (None, None), ("de", ""),
            ("en", " \t\n"), ("en", "...,,,")]
    return out + out[:20]


def frame(spark, data):
    return spark.createDataFrame([(t, la, 1, 2) for la, t in data], "text string, lang string, phrase int, F int")


def test_collocations_equal_brute_force(spark):
    data = rows()
    for min_count, percent, top in ((30, 80, 2000), (3, 50, 40), (1, 100, 5)):
        want = brute(data, 4, min_count, percent, 2_000_000, top)
        got = phrases.collocations(frame(spark, data).repartition(5), min_count=min_count, contained_percent=percent, top=top)
        got = {tuple(r) for r in got.drop("words", "extended").collect()}
        assert got == want


def test_full_bitmaps_and_slices_change_nothing(spark, monkeypatch):
    data = rows(1, 60)
    texts = frame(spark, data).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    sets = []
    for size, bits in ((1 << 21, 20), (50, 6)):
        monkeypatch.setattr(phrases, "SLICE", size)
        found, total = phrases.count_phrases(texts, 4, 5, bits, bits)
        sets.append(({(r.lang, tuple(r.words), r.f) for r in found.collect()}, {tuple(r) for r in total.collect()}))
    assert sets[0] == sets[1] and len(sets[0][0]) > 50
    slices = phrases._slices([pa.RecordBatch.from_pydict({"lang": ["x"], "text": [b"ab cd.ef " * 100]})])
    assert b"\n".join(t for _, t in slices) == b"ab cd\nef " * 100


def test_empty_tables_and_large_counts(spark):
    empty = frame(spark, [])
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("en", "")])).count() == 0
    big = spark.createDataFrame([(10**18, 2 * 10**18, 3 * 10**18)], "a long, l long, r long")
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(10,0)"),
                            F.col("l").cast("decimal(20,0)") + F.col("r")).cast("long")
    assert big.select(score).first()[0] == 400_000


def test_a_task_passes_a_phrase_on_once(monkeypatch):
    """Counts of a task's slices are summed before they leave it."""
    all_set = SimpleNamespace(value=np.full(1, 2**64 - 1, dtype=np.uint64))
    batches = [pa.RecordBatch.from_pydict({"lang": ["en", "fr"], "text": [b"a b c. d e " * 40, b"a b. " * 30]})] * 5
    monkeypatch.setattr(phrases, "SLICE", 50)
    want = Counter({("en", "a b"): 200, ("en", "b c"): 200, ("en", "a b c"): 200, ("en", "d e"): 200, ("en", "d e a"): 195,
                    ("en", "e a"): 195, ("en", "d e a b"): 195, ("en", "e a b"): 195, ("en", "e a b c"): 195, ("fr", "a b"): 150})
    for held, once in ((phrases.HELD, True), (1, False), (300, False)):
        monkeypatch.setattr(phrases, "HELD", held)
        got, n_rows = Counter(), 0
        for b in phrases._count_phrases(all_set, all_set, all_set, 4)(iter(batches)):
            assert b.schema.names == ["lang", "phrase", "f"]
            for r in b.to_pylist():
                got[r["lang"], r["phrase"]] += r["f"]
                n_rows += 1
        assert got == want and (n_rows == len(got)) == once


def test_words_of_a_slice_go_with_it():
    """What numbers a slice's words is freed at once, not by the next garbage collection."""
    folded = b" ".join(b"word%d" % i for i in range(20_000))
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(5):
            phrases._numbered(folded)
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()
        gc.enable()

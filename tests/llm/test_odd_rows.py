"""Odd rows, hot groups and rejection in the training-data operators and the pipeline."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lexforge.llm import jaccard, langid, licenses, lines, substring, warc


def test_licence_suffix_matches(spark):
    templates = {"a": "p a b c d e q", "b": "a b c d e f g h i j"}
    df = spark.createDataFrame([(0, "p a b c d e zz f g h i j"), (1, "x p a b c d e q y"), (2, "a b c d e f g h i j"),
                                (3, "a b c"), (4, None), (5, "p a b c d e f g h i j")], "doc_id long, text string")

    def spans(t):
        got = licenses.scan_licenses(df, templates=t).collect()
        return {r.doc_id: [(s.label, s.start, s.end, round(s.cover, 2)) for s in r.spans] for r in got}
    both, lone = spans(templates), spans({"b": templates["b"]})
    assert [x for x in both[0] if x[0] == "b"] == lone[0] == [("b", 1, 12, 1.0)]
    assert both[1] == [("a", 1, 8, 1.0)]
    assert both[2] == [("a", 0, 5, 0.71), ("b", 0, 10, 1.0)] and both[3] == both[4] == []
    assert both[5] == [("a", 0, 6, 0.86), ("b", 1, 11, 1.0)]


def brute_spans(words, template, min_match, gap, min_cover):
    """Chains of maximal matches of one template, from all pairs of places."""
    found = []
    for i in range(len(words)):
        for j in range(len(template)):
            if i and j and words[i - 1] == template[j - 1]:
                continue
            n = 0
            while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                n += 1
            if n >= min(min_match, len(template)):
                found.append((i, i + n, j))
    chains = []
    for s, e, at in sorted(found):
        best = next((c for c in reversed(chains) if 0 <= s - c[1] <= gap and at >= c[2]), None)
        if best:
            best[1:] = [e, at + e - s, best[3] + e - s]
        else:
            chains.append([s, e, at + e - s, e - s])
    return sorted((s, e, round(n / len(template), 6)) for s, e, _, n in chains if n >= min_cover * len(template))


def test_licence_chains_equal_brute_force(spark):
    rng = random.Random(4)
    templates = {f"t{i}": " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 12, 25]))) for i in range(6)}
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.choice([0, 1, 4])):
            t = rng.choice(list(templates.values())).split()
            lo = rng.randrange(len(t))
            words += t[lo:lo + rng.randrange(1, len(t) + 1)] + [rng.choice("abcdefghXY") for _ in range(rng.choice([0, 1, 5, 30]))]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df, templates=templates, min_match=3).collect():
        words = texts[r.doc_id].lower().split()
        for x, t in templates.items():
            got = sorted((s.start, s.end, round(s.cover, 6)) for s in r.spans if s.label == x)
            want = [(s, e, min(c, 1.0)) for s, e, c in brute_spans(words, t.split(), 3, 12, 0.6)]
            assert got == want, (texts[r.doc_id], t)


def test_licence_odd_tables(spark, tmp_dir):
    schema = "doc_id long, text string, Spans int, score string, _found int"
    out = licenses.scan_licenses(spark.createDataFrame([(1, "MIT License " + "w " * 300_000, 1, "s", 2)] * 2, schema))
    rows = out.collect()
    assert rows[0] == rows[1] and rows[0].phrase_labels == ["mit"] and rows[0].n_words == 300_002
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).count() == 0
    for name, text in (("Some-1.0.txt", "one two three four five six"), ("skip.md", "x")):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
    found = licenses.read_templates(spark, tmp_dir, ".txt")
    assert found == {"some-1.0": "one two three four five six"}


def test_substring_many_equal_rows(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(400))
    rows = [(None, text)] * 3000 + [(7, "x " + text)] + [(3, text[:len(text) // 2])]
    began = time.time()
    got = substring.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    n = {(r.doc_id, r.n_removed) for r in got.select("doc_id", "n_removed").collect()}
    words = len(text[:len(text) // 2].split())
    assert n == {(3, 0), (7, words if text[len(text) // 2] == " " else words - 1), (None, 400)}
    assert time.time() - began < 120


def test_language_rejection_by_length(spark):
    rng = random.Random(3)
    words = {"en": "the and of with that this from have not are was were".split(),
             "fr": "le les une dans pour avec être où sont était nous vous".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.choice([3, 20, 100, 400]))), x, "q", 1.0)
            for i, x in enumerate(["en", "fr"] * 150)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [" ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n)) for n in (100, 1000, 5000)]
    odd += ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n)) for n in (200, 5000)]
    odd += [" ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(6)) for _ in range(2000))]
    rows += [(1000 + i, t, None, "q", 1.0) for i, t in enumerate(odd)] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string, lang_pred double")
    out = langid.identify(df, F.col("doc_id") % 3 != 0)
    assert sorted(out.columns) == ["doc_id", "lang", "lang_pred", "rejected", "score", "text"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[1000 + i].rejected for i in range(len(odd)))
    assert [r for r in got.values() if r.doc_id < 300 and (r.rejected or r.lang_pred != ("en", "fr")[r.doc_id % 2])] == []
    assert langid.identify(spark.createDataFrame([], df.schema), F.lit(True)).count() == 0
    same = df.withColumn("doc_id", F.lit(1))            # one id for all rows
    assert {r.rejected for r in langid.identify(same, F.lit(True)).where("lang is not null").collect()} == {False}


def test_jaccard_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(4, text), (4, text), (None, text), (4, "quite another text of words"), (9, text.upper()), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, 3, 90).collect()), key=str)
    assert got == sorted([(4, 6, 4), (4, 6, 4), (None, 6, 4), (4, 3, 4), (9, 6, 4), (2, 0, 2)], key=str)


def test_lines_repeated_rows(spark):
    rows = [(1, "a\nfooter", "s", 5)] * 2 + [(i, f"t{i}\nfooter", "s", 5) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = [(r.doc_id, r.n_dropped) for r in lines.drop_boilerplate(df).collect()]
    assert sorted(got) == sorted((r[0], 1) for r in rows)


def test_warc_clashing_columns_and_hot_payload(spark):
    rows = [(i, "u", "x" * 2000 if i % 3 else f"page {i}", "shard", 1) for i in range(90)] + [(None, None, "x" * 2000, "s", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, shard int")
    folder, manifest = warc.write_warc(df, shard_bytes=20_000)
    got = warc.read_warc(folder, manifest).collect()
    assert len(got) == 91 and sum(r.record_type == "response" for r in got) == 31
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {"89"}
    shards = [r.shard for r in manifest.collect()]
    assert len(set(shards)) > 3


def run_stages(spark, docs, sf_dir):
    import corpus_pipeline
    folder = f"/tmp/lexforge-stages-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


def test_pipeline_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = base.where("length(text) > 200").limit(40).collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long, Shard string, _file string"
    rows = [(*r, "old", "f") for r in some]
    extra = [(None, *rows[0][1:]), rows[1], rows[1], (5000, None, "en", "src1", 0, "old", "f"), (5001, "", None, None, 0, "o", "f"),
             (5002, "12 34 !!", "en", None, 3, "old", "f"), (5003, rows[2][1], None, None, None, "old", None),
             (5004, " ".join(r[1] for r in rows) * 20, "en", None, 1, "old", "f")]
    out = run_stages(spark, spark.createDataFrame(rows + extra, schema).repartition(3), "/root/testdata/sf0.001")
    got = out.collect()
    assert [c for c in out.columns if c != "Shard"] == [c for c in out.columns if c.lower() != "shard" or c == "shard"]
    ids = {r.doc_id for r in got}
    assert not ids & {5000, 5001, 5002} and None not in ids and (5003 not in ids or rows[2][0] > 5003)
    keys = [(r.doc_id, r.text) for r in got]
    assert max(keys.count(k) for k in keys) <= 2
    empty = run_stages(spark, spark.createDataFrame([], schema), "/root/testdata/sf0.001")
    assert empty.count() == 0 and empty.columns == out.columns


@pytest.fixture(autouse=True)
def _batches(spark):
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

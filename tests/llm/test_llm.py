"""The training-data operators against brute force, on small rows with every odd case."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import decontaminate, jaccard, langid, licenses, lines, mixing, neighbors, sharding, substring, warc
from lexforge.llm.automaton import SuffixAutomaton
from lexforge.llm.components import components
from lexforge.llm.tokens import ALNUM, SPACE, Tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Size string, _key int, spans int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def space(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def corpus(seed=0, n=60):
    """Random texts with copies, near copies, shared passages, nulls, blanks, long and repeated rows."""
    rng = random.Random(seed)
    vocab = [a + b for a in "abcdeFGß" for b in ("", "x", "yy", "é")]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    rows, texts = [], []
    for i in range(n):
        t = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 12, 13, 14, 40, 90]))]
        if texts and rng.random() < 0.3:
            t = rng.choice(texts).split(" ")
            if len(t) > 5 and rng.random() < 0.6:
                t[rng.randrange(len(t))] = "edit"
        if rng.random() < 0.2:
            t = t[:5] + passage.split(" ") + t[5:]
        texts.append(" ".join(t))
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(t)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "w " * 3000), (n + 4, "w " * 2990 + "end")]
    full = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None, "Ω"]),
             len(t or ""), "x", 7, 8) for i, t in rows]
    return full


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def test_tokens_and_automaton():
    t = Tokens([b"Ab  c", None, "é\x85 ".encode(), b"", b"x" * 50], SPACE, True)
    assert [t.words(t.first[i], t.first[i + 1]) for i in range(5)] == [
        [b"ab", b"c"], [], ["é\x85".encode()], [], [b"x" * 50]]
    a = SuffixAutomaton([[b"a", b"b", b"a"], [b"b"], []], ["x", "y", "z"], 2)
    t = Tokens([b"a b a c b"], ALNUM, True)
    got = {(s, e, n) for s, e, names in a.hits(t) for n in names}
    assert got == {(0, 2, "x"), (1, 3, "x"), (1, 2, "y"), (4, 5, "y")}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for u, v in links:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    loops = {u for u, v in links if u == v}
    assert {k: v for k, v in got.items()} == {x: find(x) for u, v in links for x in (u, v) if u != v} | {
        x: find(x) for x in loops if x in got}


def test_mixing(spark, docs):
    rows = mixing.mix(docs, mixing.word_count("text")).collect()
    assert len(rows) == docs.count()
    size = {}
    for r in corpus():
        size[r[3]] = size.get(r[3], 0) + len(space(r[1]))
    total, longest = sum(size.values()), max(len(space(r[1])) for r in corpus())
    by = {}
    for r in rows:
        assert r["size"] == len(space(r["text"])) and 0 <= r["copies"] <= 2 and r["source_size"] == size[r["source"]]
        by[r["source"]] = by.get(r["source"], 0) + r["size"] * r["copies"]
    target = {r["source"]: r["target"] for r in rows}
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level = next(x for x in sorted(2 * size[s] / weight[s] for s in size)
                 if sum(min(2 * size[s], x * weight[s]) for s in size) >= 1.5 * total - 1e-6)
    lo = 0.0
    for _ in range(200):
        mid = (lo + level) / 2
        lo, level = (lo, mid) if sum(min(2 * size[s], mid * weight[s]) for s in size) >= 1.5 * total else (mid, level)
    for s in size:
        assert target[s] == pytest.approx(min(2 * size[s], level * weight[s]), rel=1e-6)
        assert abs(by[s] - target[s]) <= 2 * longest
    again = mixing.mix(docs.repartition(5), mixing.word_count("text"))
    assert sorted((r.doc_id, r.copies) for r in again.collect()) == sorted((r.doc_id, r.copies) for r in rows)
    assert mixing.mixed(docs, mixing.word_count("text")).columns == docs.columns
    assert mixing.mix(docs.limit(0), mixing.word_count("text")).count() == 0


def test_mixing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 6 + [(None, None, None)] * 2, "doc_id long, text string, source string")
    rows = mixing.mix(df, mixing.word_count("text")).collect()
    assert sorted(r["copies"] for r in rows if r["doc_id"] == 1) == [1, 1, 1, 2, 2, 2]


def test_decontaminate(spark, docs):
    words = [alnum(r[1]) for r in corpus()]
    long = max(words[:60], key=len)
    items = [(1, " ".join(long[3:25]).upper()), (2, "EDIT"), (10, "ayy, ayy"), (3, None), (4, " .. "), (None, "w w w"),
             (1, " ".join(long[30:45]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 4):
        found = decontaminate.find_contamination(docs, table, block_words=block)
        got = {r.doc_id: r for r in found.select("doc_id", *decontaminate.contamination_digest(found)).collect()}
        for row, w in zip(corpus(), words):
            hit, ids = set(), set()
            for key, text in items:
                p = alnum(text)
                for s in ([p[i:i + 10] for i in range(len(p) - 9)] if len(p) >= 10 else [p] if p else []):
                    for i in range(len(w) - len(s) + 1):
                        if w[i:i + len(s)] == s:
                            hit |= set(range(i, i + len(s)))
                            ids |= {str(key)} - {"None"}
            r = got[row[0]]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    clean = decontaminate.decontaminate(docs, table, min_span=1, max_coverage=1.0)
    again = decontaminate.find_contamination(clean.drop("n_words", "spans", "items", "n_hit"),
                                             table.where("item_id = 2"))
    assert again.where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), table).count() == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    texts = [None, "", "The MIT License, mit license!", "x apache licence", "GENERAL public license general Public License v3",
             f"intro words {mit} trailing", " ".join(mit.split()[:8]), "mit\n-license " * 50, "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        w = alnum(r.text)
        places = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert r.n_words == len(w) and r.places == sorted(i for i, _ in places)
        assert r.phrase_labels == sorted({x for _, x in places}) and 0 <= r.score <= 1
        assert [s.label for s in r.spans] == {5: ["mit"], 8: ["cc-by-nc"]}.get(r.doc_id, [])
        if r.doc_id == 5:
            assert (r.spans[0].start, r.spans[0].end) == (2, 2 + len(alnum(mit)))


def test_substring(spark, docs):
    seen, want = {}, {}
    for row in corpus():
        w, gone = space(row[1]), set()
        for i in range(len(w) - 12):
            if seen.setdefault(tuple(w[i:i + 13]), row[0]) < row[0]:
                gone |= set(range(i, i + 13))
        want[row[0]] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone).encode())
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring.remove_duplicates(docs).collect()}
    assert got == want
    odd = spark.createDataFrame([(None, "a " * 20), (5, "a " * 20), (5, "b " * 20), (5, "a " * 20), (9, "b " * 30)],
                                "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.remove_duplicates(odd).collect())
    assert got == [("5", 20, 0)] * 3 + [("9", 30, 30), ("None", 20, 20)]
    assert substring.remove_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 0), (5, 80, 3)])
def test_jaccard(spark, k, percent, seed):
    rows = corpus(seed)
    sets = {}
    for r in rows:
        w = space(r[1], lower=True)
        sets[r[0]] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((comp[a], comp[b]))
            comp = {i: lo if c == hi else c for i, c in comp.items()}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, k, percent).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}
    if k == 5:
        kept = jaccard.one_per_class(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in comp.items() if i == c)


def test_one_per_class_odd_ids(spark):
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta"
    c, d = "red green blue white black grey pink", "un deux trois quatre cinq six sept"
    rows = ([(1, a, "s")] * 40 + [(2, a, "s"), (None, a, "s")]     # repeated rows, a larger and a null id
            + [(1, b, "s"), (0, b, "t")]                           # an id that another class keeps
            + [(None, c, "s"), (None, c, "t"), (None, c, "t")]     # only null ids
            + [(None, d, "s"), (7, d, "s")]                        # null beside a known id
            + [(3, c + " " + a, "t"), (3, c + " " + a, "u")]       # equal but for another column
            + [(1, None, "s"), (1, None, "s"), (None, " ", None)])  # no shingles
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = jaccard.one_per_class(df)
    assert kept.columns == df.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(r[:2] for r in got if r[1] and r[1].strip() and r[1] != c) == [
        (0, b), (1, a), (3, c + " " + a), (7, d)]
    assert [r[:2] for r in got if r[1] == c] == [(None, c)]
    assert sorted((r for r in got if not (r[1] or "").strip()), key=str) == [
        (1, None, "s"), (1, None, "s"), (None, " ", None)]
    assert set(got) <= set(rows)


def test_lines(spark, docs):
    rows = corpus()
    pages, seen = {}, {}
    for r in rows:
        pages[r[3]] = pages.get(r[3], 0) + 1
        for x in {x.strip(" ") for x in (r[1] or "").split("\n")} - {""}:
            seen[r[3], x] = seen.get((r[3], x), 0) + 1
    bad = {k for k, n in seen.items() if n >= 2 and n > 0.05 * pages[k[0]]}
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs, max_ratio=0.05, min_pages=2).collect()}
    assert bad
    for r in rows:
        parts = (r[1] or "").split("\n") if r[1] is not None else []
        kept = [x for x in parts if (r[3], x.strip(" ")) not in bad]
        g = got[r[0]]
        assert (g.n_lines, g.n_dropped) == (len(parts), len(parts) - len(kept))
        assert g.text == (None if r[1] is None else "\n".join(kept))
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard(docs.union(docs.limit(3)), 4).collect()
    counts = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)]
    assert [x == list(range(len(x))) for x in counts] == [True] * 4
    assert max(map(len, counts)) - min(map(len, counts)) <= 1 and len(rows) == docs.count() + 3
    for source in {r.source for r in rows}:
        per = [sum(r.source == source for r in rows if r["shard"] == s) for s in range(4)]
        assert max(per) - min(per) <= 2
    assert sharding.shard(docs.limit(0), 4).count() == 0


def test_warc_round_trip(spark):
    rng = random.Random(4)
    big = ["".join(rng.choice("abcdé\r\n<>") for _ in range(2000)) for _ in range(4)]
    rows = [(i, f"http://h/{i} \n", rng.choice([*big, "small", "", None])) for i in range(80)]
    rows += [(100, None, big[0]), (101, "http://u", "x" * 999), (102, "http://u", "x" * 999), (5, "http://h/5", big[1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, manifest = warc.write_warc(df, shard_bytes=30_000, file_bytes=2_000)
    files = sorted(r.file for r in manifest.collect())
    assert len(files) > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    top = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, -1), i)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                   "revisit" if top.get(h, i) != i else "response", str(top[h]) if top.get(h, i) != i else "")
                  for i, _, h in rows)
    got = sorted((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "")
                 for r in warc.read_warc(folder, manifest).collect())
    assert got == want
    again, second = warc.write_warc(df.repartition(7), shard_bytes=30_000, file_bytes=2_000)
    assert sorted(r.file for r in second.collect()) == files
    for f in files:      # the same bytes whatever the partitions of the input were
        assert open(f"{folder.replace('file:', '')}/{f}", "rb").read() == open(f"{again.replace('file:', '')}/{f}", "rb").read()
    folder, manifest = warc.write_warc(df.limit(0))
    assert warc.read_warc(folder, manifest).count() == 0


def test_language_id(spark):
    rng = random.Random(2)
    words = {"en": "the and of with that this from have".split(), "fr": "le les une dans pour avec être où".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i, x in enumerate(["en", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !! 456", "fr"), (1002, "", None), (1003, "the and of", None),
             (None, "les une dans", None), (1004, "the " * 200_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = {r.doc_id: r for r in langid.identify(df, ~held).collect()}
    for i, x in enumerate(["en", "fr"] * 60):
        assert got[i].lang_pred == x and 0 < got[i].score <= 1 and not got[i].rejected
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "fr"]
    assert all(got[i].rejected for i in (1000, 1001, 1002))
    none = langid.identify(df, F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_neighbors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)) * rng.uniform(0.5, 2, (700, 1))
    x[300:400] = x[299] + rng.normal(size=(100, 16)) * 1e-3      # a crowded cell
    x[410] = x[411] = x[412]                                     # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0] * 3),
           (1100, [float("inf")] + [0.0] * 15), (1120, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbors.nearest(df, df.where("vec_id % 20 = 0"), block=32).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [f[1] for f in found] == [f[1] for f in sorted(found, key=lambda f: (-f[2], f[1]))]
        for _, v, s in found:
            assert s == pytest.approx(float(x[q] @ x[v]), rel=1e-12, abs=1e-12)
        best = sorted((-float(x[q] @ x[v]), v) for v in range(700) if v != q)[:20]
        hit += len({v for _, v in best} & {f[1] for f in found})
    assert hit >= 0.9 * 20 * len(got)
    few = neighbors.nearest(df.where("vec_id < 9"), df.where("vec_id = 0"))
    assert sorted(r.vec_id for r in few.collect()) == list(range(1, 9))
    assert neighbors.nearest(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    source = {r.doc_id: r for r in docs.collect()}
    items = [alnum(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    sets = {}
    for i, r in source.items():
        w = space(r.text, lower=True)
        if re.search(r"[^\W\d_]", r.text or ""):
            sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((comp[a], comp[b]))
            comp = {i: lo if c == hi else c for i, c in comp.items()}
    grams = {tuple(p[i:i + 10]) for p in items for i in range(max(1, len(p) - 9))}
    clean = set()
    for i in (i for i, c in comp.items() if i == c):
        w = alnum(source[i].text)
        if not any(tuple(w[j:j + len(g)]) == g for g in grams for j in range(len(w))):
            clean.add(i)
    kept = [r.doc_id for r in rows]
    assert set(kept) <= clean and max(kept.count(i) for i in set(kept)) <= 2
    total = {s: sum(len(space(source[i].text)) for i in clean if source[i].source == s) for s in {source[i].source for i in clean}}
    taken = sum(len(space(source[i].text)) for i in kept)
    longest = max(len(space(source[i].text)) for i in clean)
    assert abs(taken - 1.5 * sum(total.values())) <= longest
    assert all(source[r.doc_id].text == r.text for r in rows)
    counts = [sum(r["shard"] == s for r in rows) for s in range(40)]
    assert max(counts) - min(counts) <= 1

"""Text functions on the edge rows of FIXTURES section 3."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import sentences

EDGE = ["", "   ", "\n", "3.5% U.S. ok?! Yes.", "Café déjà vu", "漢字かな交じり文", "😀😀 ok",
        "a\tb\x0bc\x0cd", "Hello world. How are you? Fine!  Thanks.\nNew line"]


def _df(spark):
    return spark.createDataFrame(list(enumerate(EDGE)), "doc_id long, text string")


def test_sentence_split(spark):
    got = {(r.doc_id, r.sent_idx): r.sentence
           for r in sentences.split_sentences(_df(spark)).collect()}
    assert (0, 0) not in got and (1, 0) not in got and (2, 0) not in got
    assert got[(3, 0)] == "3.5% U.S." and got[(3, 1)] == "ok?!" and got[(3, 2)] == "Yes."
    assert [got[(8, i)] for i in range(4)] == ["Hello world.", "How are you?", "Fine!", "Thanks."]
    assert got[(8, 4)] == "New line"


def test_clean_words_equals_clean_then_split(spark):
    df = _df(spark)
    a = df.select("doc_id", tx.clean_words("text").alias("w")).collect()
    b = df.select("doc_id", tx.split_words(tx.clean_ascii("text")).alias("w")).collect()
    assert {r.doc_id: r.w for r in a} == {r.doc_id: r.w for r in b}
    d = {r.doc_id: r.w for r in a}
    assert d[3] == ["3", "5", "U", "S", "ok", "Yes"]
    assert d[4] == ["Caf", "dj", "vu"]          # non-ASCII dropped, not split
    assert d[7] == ["a", "b", "c", "d"]
    assert d[0] == [] and d[1] == []


def test_pretokenize_and_normalize_parity(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import normalizers, pre_tokenizers
    norm = normalizers.Sequence([normalizers.NFKD(), normalizers.Replace("\n", " "),
                                 normalizers.Lowercase(), normalizers.StripAccents(), normalizers.Strip()])
    pre = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.Punctuation()])
    texts = EDGE + ["don't x_y !! ¡Hola! ﬁne №5 Ⅻ é", "  Ünïcödé\tTEXT  nbsp"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", tx.normalize("text").alias("n"),
                     tx.pretokenize(tx.normalize("text")).alias("t")).collect()
    for r in rows:
        exp_n = norm.normalize_str(texts[r.doc_id])
        assert r.n == exp_n, (texts[r.doc_id], r.n, exp_n)
        assert r.t == [w for w, _ in pre.pre_tokenize_str(exp_n)], texts[r.doc_id]
    del tokenizers


def test_end_of_word_and_mmss(spark):
    df = spark.createDataFrame([("ab", 0.0), ("a", 59.9), ("😀x", 3725.0)], "w string, s double")
    r = df.select(tx.end_of_word_symbols("w", "</w>").alias("lib"), tx.end_of_word_symbols("w", " ").alias("sp"),
                  tx.seconds_to_mmss("s").alias("mm")).collect()
    assert r[0].lib == ["a", "b</w>"] and r[0].sp == ["a", "b", " "]
    assert r[1].lib == ["a</w>"] and r[1].mm == "00:59"
    assert r[2].lib == ["😀", "x</w>"] and r[2].mm == "62:05"
    assert r[0].mm == "00:00"


def test_fold_newlines_and_ascii(spark):
    r = _df(spark).select("doc_id", tx.fold_newlines("text").alias("a"), tx.ascii_fold("text").alias("b"),
                          tx.whitespace_fold(tx.punct_to_space("text")).alias("c")).collect()
    d = {x.doc_id: x for x in r}
    assert d[2].a == " " and d[4].b == "Caf dj vu" and d[3].c == "3 5 U S ok Yes "
    assert F is not None


def test_normalize_rows_like_the_library(spark):
    pytest.importorskip("tokenizers")
    from tokenizers import normalizers
    norm = normalizers.Sequence([normalizers.NFKD(), normalizers.Replace("\n", " "),
                                 normalizers.Lowercase(), normalizers.StripAccents(), normalizers.Strip()])
    texts = EDGE + ["  Plain ASCII Line\n", "Mixed café\tText ", "\x1c ascii sep \x1f",
                    "हिन्दी भाषा", "தமிழ் மொழி", "বাংলা", "မြန်မာစာ", "ΟΔΟΣ ΟΔΟΣ.", "x\u20dd y", "İSTANBUL", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in tx.normalize_rows(df, "text", "n").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == norm.normalize_str(t), repr(t)


def test_sentence_split_keeps_control_characters(spark):
    df = spark.createDataFrame([(0, "one\x01two. Three"), (1, "a.) b!\"\n c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.p for r in df.select("doc_id", tx.sentence_parts("text").alias("p")).collect()}
    assert got == {0: ["one\x01two.", "Three"], 1: ["a.)", "b!\"", "c"], 2: None}


def test_sentence_split_equals_a_plain_rule(spark):
    """Against one pass over the characters: no bound on closers, no marker character, no deep recursion."""
    import random

    def plain(text):
        out, start, i = [], 0, 0
        while i < len(text):
            j = i + 1
            if text[i] in ".!?":
                while j < len(text) and text[j] in "\"')]":
                    j += 1
                k = j
                while k < len(text) and text[k] in "\t\n\x0b\f\r ":
                    k += 1
                if k > j:
                    out.append(text[start:j])
                    start = j = k
            i = j
        return [x for x in [*out, text[start:]] if x.strip("\t\n\x0b\f\r ")]

    rng = random.Random(0)
    texts = ["".join(rng.choice("ab.!?\"')] \n\t\x0b\x01é") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(500)]
    texts += ["a." + ")" * 65 + " b", "a." + "]" * 500 + "\nb", "x\x01y. z", "a.b" * 100_000 + ". c", "." * 50_000, " \n",
              "  Lead. tail ", "\u2028a. b\u0085c. d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [[] for _ in texts]
    for r in sentences.split_sentences(df).orderBy("doc_id", "sent_idx").collect():
        assert r.sent_idx == len(got[r.doc_id])
        got[r.doc_id].append(r.sentence)
    assert got == [plain(t) for t in texts]

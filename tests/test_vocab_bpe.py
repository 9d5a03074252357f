"""Word counts, coverage cut, exact batched BPE and encoder parity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bpe_reference import train_sequential
from lexforge.functions import text as tx
from lexforge.operators import bpe, dictionary, vocab


def _counts(spark, pairs):
    return spark.createDataFrame(pairs, "word string, n long")


def test_coverage_cut_inclusive_and_ties(spark):
    # total 100; shares 40, 30, 20 -> 90% reached exactly by 'c' (included), ties by word
    c = _counts(spark, [("b", 30), ("a", 40), ("c", 20), ("e", 5), ("d", 5)])
    got = [(r.word, r.rank) for r in vocab.coverage_cut(c).orderBy("rank").collect()]
    assert got == [("a", 0), ("b", 1), ("c", 2)]
    # equal counts: order by word, cut inside the tie group
    c2 = _counts(spark, [(w, 10) for w in "jihgfedcba"])
    got2 = [r.word for r in vocab.coverage_cut(c2).orderBy("rank").collect()]
    assert got2 == list("abcdefghi")        # 9 x 10 = 90% reached by the 9th word
    assert vocab.coverage_cut(_counts(spark, [("x", 1)])).count() == 1


def test_word_counts_edges(spark):
    df = spark.createDataFrame([(0, "aaa abab a"), (1, "aaa, ABAB!"), (2, "")], "doc_id long, text string")
    got = {r.word: r.n for r in vocab.word_counts(df).collect()}
    assert got == {"aaa": 2, "abab": 1, "a": 1, "ABAB": 1}
    tot = vocab.corpus_totals(vocab.word_counts(df)).first()
    assert (tot.total_words, tot.distinct_words) == (5, 4)


def _spark_vs_sequential(spark, words, n_merges, k=8):
    df = spark.createDataFrame(list(words.items()), "word string, freq long")
    sym, model = bpe.initial_symbols_space(df)
    init = {tuple(r.sym): r.freq for r in sym.collect()}
    pieces0 = list(model.pieces)
    got = bpe.train(sym, model, n_merges=n_merges, k=k)
    exp, _ = train_sequential(init, pieces0, n_merges=n_merges)
    return [tuple(m) for m in got.merges], [tuple(m) for m in exp]


def test_bpe_self_pairs_and_overlaps(spark):
    got, exp = _spark_vs_sequential(spark, {"aaa": 5, "aaaa": 3, "abab": 4, "a": 2, "ba": 1}, 12)
    assert got == exp and len(got) > 3


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_bpe_random_tiny_vocabularies(spark, seed):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7))): rnd.randint(1, 30)
             for _ in range(40)}
    got, exp = _spark_vs_sequential(spark, words, 30, k=16)
    assert got == exp


def test_apply_merges_left_to_right(spark):
    df = spark.createDataFrame([(["a", "a", "a"],), (["a", "b", "a", "b"],), (["b", "a", "a", "b"],)], "s array<string>")
    self_pair = [r[0] for r in df.select(bpe.apply_merges(F.col("s"), [("a", "a", "aa")])).collect()]
    assert self_pair == [["aa", "a"], ["a", "b", "a", "b"], ["b", "aa", "b"]]
    disjoint = [r[0] for r in df.select(bpe.apply_merges(F.col("s"), [("a", "b", "ab")])).collect()]
    assert disjoint == [["a", "a", "a"], ["ab", "ab"], ["b", "a", "ab"]]


def test_library_bpe_parity_with_tokenizers(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers
    rnd = random.Random(11)
    vocab_words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
    texts = []
    for i in range(400):
        n = rnd.randint(3, 12)
        texts.append(" ".join(vocab_words[min(int(rnd.paretovariate(1.2)) - 1, 59)] for _ in range(n)) + ".")
    size = 140
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.normalizer = normalizers.Sequence([normalizers.NFKD(), normalizers.Replace("\n", " "),
                                           normalizers.Lowercase(), normalizers.StripAccents(),
                                           normalizers.Strip()])
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.Punctuation()])
    alphabet = list(tx.ALPHABET)
    trainer = trainers.BpeTrainer(vocab_size=size, special_tokens=["[UNK]", "[PAD]", "[MASK]"],
                                  initial_alphabet=alphabet, limit_alphabet=len(alphabet),
                                  min_frequency=5, end_of_word_suffix="</w>", show_progress=False)
    tok.train_from_iterator(texts, trainer)
    import json
    ref = json.loads(tok.to_str())["model"]
    ref_merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in ref["merges"]]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = vocab.word_counts(df, words=tx.pretokenize(tx.normalize("text"))) \
        .select("word", F.col("n").alias("freq"))
    model = bpe.train_library(words, size, min_frequency=5, k=16)
    ours = [(model.pieces[a], model.pieces[b]) for a, b, _, _ in model.merges]
    assert len(model.pieces) == tok.get_vocab_size()
    assert set(model.pieces) == set(ref["vocab"])
    assert ours == ref_merges
    # encoding parity (pieces) on the training texts
    enc = bpe.word_encoder(model)
    got = df.select("doc_id", enc(tx.pretokenize(tx.normalize("text"))).alias("ids")).orderBy("doc_id").collect()
    for r in got[:50]:
        assert [model.pieces[i] for i in r.ids] == tok.encode(texts[r.doc_id]).tokens
    del tokenizers


def test_coverage_cut_beyond_1e13_words(spark):
    df = spark.createDataFrame([("a", 8 * 10**15), ("b", 10**15), ("c", 9 * 10**14), ("d", 10**14)], "word string, n long")
    assert [r.word for r in vocab.coverage_cut(df).orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize("seed, k, runs", [(1, 1, 50), (2, 3, 50), (3, 8, 4), (4, 64, 50), (5, 8, 50)])
def test_bpe_rounds_of_runs(spark, monkeypatch, seed, k, runs):
    monkeypatch.setattr(bpe, "RUNS", runs)
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abc" if seed % 2 else "ab") for _ in range(rnd.randint(1, 9))): rnd.randint(1, 4)
             for _ in range(40)}
    got, exp = _spark_vs_sequential(spark, words, 60, k=k)
    assert got == exp and len(got) > 20


def test_bpe_queries_have_the_reference_sizes():
    from lexforge.plans import catalog
    assert (catalog.H1_VOCAB, catalog.H2_MERGES) == (15_000, 10_000)


class Killed(Exception):
    pass


@pytest.mark.parametrize("library", [False, True])
def test_training_goes_on_from_its_merge_log(spark, tmp_dir, library):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))): rnd.randint(1, 30) for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "word string, freq long")

    def run(log, on_round=None):
        start = bpe.initial_symbols_library if library else bpe.initial_symbols_space
        sym, model = start(df)
        return bpe.train(sym, model, vocab_size=len(model.pieces) + 40, k=2, on_round=on_round, log=log, log_every=7)

    def kill(rounds, *_):
        if rounds == 4:
            raise Killed
    whole = run(None)
    assert len(whole.merges) > 30
    with pytest.raises(Killed):
        run(f"{tmp_dir}/log", kill)
    some = bpe.read_merge_log(spark, f"{tmp_dir}/log").count()
    assert 0 < some < len(whole.merges) and some % 7 == 0
    again = run(f"{tmp_dir}/log")
    assert (again.merges, again.pieces, again.kinds) == (whole.merges, whole.pieces, whole.kinds)
    logged = bpe.read_merge_log(spark, f"{tmp_dir}/log").orderBy("rank").collect()
    assert [tuple(r) for r in logged] == whole.merge_rows()
    assert run(f"{tmp_dir}/log").merges == whole.merges            # nothing left to do
    other = spark.createDataFrame([("xyz", 3)], "word string, freq long")
    with pytest.raises(ValueError):
        sym, model = bpe.initial_symbols_space(other)
        bpe.train(sym, model, n_merges=3, log=f"{tmp_dir}/log")


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_dictionary_encoding_equals_the_word_encoder(spark, hot):
    rnd = random.Random(7)
    texts = [" ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.choice([0, 1, 9, 60])))
             for _ in range(80)] + ["the " * 500, None, "", "abc abc abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    df = df.withColumn("words", tx.pretokenize(tx.normalize("text")))
    counts = vocab.word_counts(df, words=F.col("words")).select("word", F.col("n").alias("freq"))
    model = bpe.train_library(counts, 160, min_frequency=2)
    ids = dictionary.build(df, F.col("words"), model)
    assert ids.count() == counts.count()
    got = dictionary.encode(df, "words", ids, ["doc_id"], hot=hot)
    want = {r.doc_id: r.x for r in df.select("doc_id", bpe.word_encoder(model)(F.col("words")).alias("x")).collect()}
    assert {r.doc_id: r.raw_ids for r in got.collect()} == want
    assert want[81] is None and want[82] == [] and len(want[80]) >= 500


def _one_by_one(ids, merges, in_order):
    rank = {(a, b): (r, a, b, m) for r, (a, b, m) in enumerate(merges)}
    done = -1
    while found := [h for h in map(rank.get, zip(ids, ids[1:])) if h is not None and (not in_order or h[0] > done)]:
        done, a, b, m = min(found)
        ids = bpe._merge_once(ids, a, b, m)
    return ids


@pytest.mark.parametrize("in_order", [True, False])
def test_merges_of_a_whole_batch_equal_word_by_word(in_order):
    rnd = random.Random(11)
    words = [[rnd.randint(0, 3) for _ in range(rnd.choice([0, 1, 2, 5, 9, 30]))] for _ in range(300)] + [[1] * 41, [], [2] * 6]
    flat, lengths = np.array(sum(words, []), dtype=np.int64), np.array([len(w) for w in words])
    for n in (0, 1, 6, 25):
        merges = [(rnd.randint(0, 3 + i), rnd.randint(0, 3 + i), 4 + i) for i in range(n)]
        got, sizes = bpe._MergeTable(merges).merge(flat, lengths, in_order)
        got = [x.tolist() for x in np.split(got, np.cumsum(sizes)[:-1])]
        assert got == [_one_by_one(w, merges, in_order) for w in words]
        empty = bpe._MergeTable(merges).merge(flat[:0], lengths[:0], in_order)
        assert len(empty[0]) == len(empty[1]) == 0


def test_pair_sums_equal_pair_counts(spark):
    rnd = random.Random(3)
    rows = [([rnd.randint(0, 4) for _ in range(rnd.choice([1, 2, 7]))], rnd.choice([1, 2, 2**55 + 1])) for _ in range(60)]
    words = spark.createDataFrame(rows + [([5, 5, 5], 3)], "sym array<int>, freq long").repartition(3)
    assert {tuple(r) for r in bpe.pair_sums(words).collect()} == {tuple(r) for r in bpe.pair_counts(words).collect()}
    assert bpe.pair_sums(words.limit(0)).count() == 0


def test_words_are_trained_and_encoded_by_many_tasks(spark):
    counts = spark.range(300).select(F.col("id").cast("string").alias("word"), F.lit(1).alias("n")).groupBy("word").agg(
        F.sum("n").alias("n"))
    assert bpe.spread_words(counts).select(F.spark_partition_id()).distinct().count() > 1
    ids = dictionary.build(counts, F.array("word"), bpe.BpeModel(pieces=["1"], kinds=["char"]))
    assert ids.count() == 300 and ids.select(F.spark_partition_id()).distinct().count() > 1


def test_encoding_a_corpus_caches_no_rows(spark, monkeypatch):
    """Sentences go through tables: a cache of them stands in an executor's memory beside the Python workers."""
    from lexforge.plans import corpus_shards
    s = spark.createDataFrame([(0, "Abc abd. abc"), (1, ""), (2, None), (3, "abd xyz")], "example_id long, sentence string")
    model = bpe.BpeModel(pieces=["[UNK]", "[PAD]", "[MASK]", "a", "b", "c</w>", "ab"], merges=[(3, 4, 6, 9)])
    kept = []
    monkeypatch.setattr(type(s), "persist", lambda df, *a: kept.append(df) or df)
    monkeypatch.setattr(type(s), "cache", lambda df: kept.append(df) or df)
    p = corpus_shards.ShardParams(seq_len=4)
    for hot in (0, 1, 9):
        out = corpus_shards.encode_sentences_bpe(s, model, p, keep_raw=True, hot=hot).orderBy("example_id").collect()
        assert [r.raw_ids for r in out] == [[6, 5, 6, 0, 0, 6, 5], [], None, [6, 0, 0, 0, 0]]
        assert [r.sentence for r in out] == ["Abc abd. abc", "", None, "abd xyz"]
    assert not kept


def test_pair_sums_are_added_up_while_they_are_held(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [([rnd.randint(0, 30) for _ in range(rnd.choice([1, 4, 9]))], rnd.randint(1, 9)) for _ in range(400)]
    words = spark.createDataFrame(rows, "sym array<int>, freq long").coalesce(1)
    want = {tuple(r) for r in bpe.pair_counts(words).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for held in (1, 200, 100_000):
            monkeypatch.setattr(bpe, "HELD_PAIRS", held, raising=True)
            assert {tuple(r) for r in bpe.pair_sums(words).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

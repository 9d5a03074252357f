"""End-to-end plans P1-P3 on the smallest driver tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexforge.operators import masking
from lexforge.plans import corpus_shards, tokenizer, training_feed
from lexforge.sources import files
from lexforge.sources.tables import read_table


def test_p1_p3_token_table_to_masked_batches(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    p = corpus_shards.ShardParams(n_shards=4, file_size=100, seq_len=16)
    tok = corpus_shards.token_table(docs, vocab_size=500, p=p).cache()
    n = tok.count()
    assert n > 0 and tok.where(F.size("ids") != 16).count() == 0
    assert tok.select("example_id").distinct().count() == n
    assert tok.groupBy("shard", "file_idx").count().where("count > 100").count() == 0
    out = training_feed.masked_batches(tok, 64, n_epochs=2, cfg=masking.MaskConfig(vocab_high=500))
    rows = out.select("epoch", "batch_id", "example_id").collect()
    assert len(rows) == 2 * (n // 64) * 64
    assert {r.epoch for r in rows} == {0, 1}


def test_p2_tokenizer_artifact(spark, tmp_dir):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    model = tokenizer.build_tokenizer(docs, vocab_size=140, seq_len=32, out_path=f"{tmp_dir}/tk",
                                      n_docs=50, min_frequency=5)
    loaded, meta = files.load_tokenizer(spark, f"{tmp_dir}/tk")
    assert loaded.pieces == model.pieces[:140] and meta.seq_len == 32
    assert len(model.pieces) <= 140 and len(model.merges) > 0


def test_token_table_is_split_and_encoded_once(spark):
    """Texts are split and encoded before the in-shard order, which reads them several times."""
    from lexforge.plans import corpus_shards as P1
    docs = spark.createDataFrame([(i, f"One two {i}. Three four! " * (i % 4) if i % 5 else None) for i in range(60)],
                                 "doc_id long, text string")
    p = P1.ShardParams(n_shards=3, file_size=7, seq_len=4)
    got = P1.token_table(docs, 12, p, keep_raw=True)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = P1.encode_sentences(P1.with_example_ids(P1.shard_sentences(docs, p), p), P1.word_vocab(docs, 12), p, keep_raw=True)
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(*got.columns).collect()))


def test_word_vocabulary_is_a_top_k(spark, monkeypatch):
    """Only the words of the vocabulary are put in order, by the same rule as the whole ranking."""
    docs = spark.createDataFrame([(0, "b a c a B d"), (1, "c e e"), (2, None), (3, "")], "doc_id long, text string")
    ranked = corpus_shards.vocab.most_common(corpus_shards.vocab.word_counts(docs, words=corpus_shards.word_tokens("text")))
    words = [r.word for r in ranked.orderBy("rank").collect()]
    monkeypatch.setattr(corpus_shards.vocab, "most_common", None)
    for size in (2, 3, 5, 50):
        got = corpus_shards.word_vocab(docs, size).orderBy("token_id").collect()
        assert [(r.token_id, r.piece) for r in got] == list(enumerate(
            corpus_shards.vocab.SPECIAL_TOKENS + words[:max(size - 3, 0)]))

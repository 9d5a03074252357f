"""Corpus -> shuffled, sharded, sentence-split, encoded token files.

One lazy plan: seeded document order (D1) -> shards (D3) -> sentences (E2)
-> in-shard order (D4) -> fixed-size files (D7) -> encode + truncate + pad
(H5-H8) -> ``tokens(shard, file_idx, row, example_id, rel_path, ids)``
ready for the parquet sink (B4).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import bpe, dictionary, encode, sampling, sentences, vocab
from lexforge.operators.positions import ordered_running
from lexforge.session import drop_written, written


@dataclass(frozen=True)
class ShardParams:
    seed: int = 0
    n_shards: int = 8
    file_size: int = 1000
    seq_len: int = 64
    shuffle_dataset: bool = True
    shuffle_shards: bool = True
    sentencize: bool = True
    shard_mode: str = "contiguous"


def shard_sentences(docs: DataFrame, p: ShardParams = ShardParams(),
                    each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows ``(doc_id, shard, sent_idx, sentence, pos)``; ``pos`` is the
    dense position inside the shard.

    ``each`` works on the sentences before they are put in order; as the order
    is read several times, it should write what it returns."""
    if p.shuffle_dataset:
        d = sampling.shuffle_positions(docs, "doc_id", p.seed)
    else:
        d = sampling.stable_positions(docs, ["doc_id"])
    total = docs.agg(F.count(F.lit(1))).scalar()
    d = sampling.assign_shards(d, "pos", p.n_shards, p.shard_mode, total=total)
    if p.sentencize:
        s = sentences.split_sentences(d.withColumnRenamed("pos", "doc_pos"))
    else:
        s = (d.withColumnRenamed("pos", "doc_pos").withColumn("sent_idx", F.lit(0))
             .withColumnRenamed("text", "sentence"))
    if each is not None:
        s = each(s)
    if p.shuffle_shards:
        return sampling.shuffle_positions(s, ["doc_id", "sent_idx"], p.seed, partition=["shard"])
    return ordered_running(s, [F.col("doc_pos"), F.col("sent_idx")], ["shard"], pos_col="pos")


def with_example_ids(s: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """Files (D7) and a global dense ``example_id`` = shard offset + pos."""
    s = sampling.chunk(s, "pos", p.file_size, row_col="row")
    sizes = s.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    offsets = ordered_running(sizes, [F.col("shard")], pos_col=None, sums={"_off": "_n"}, small=True)
    # one row per shard (bounded by n_shards): broadcast is safe
    s = s.join(F.broadcast(offsets.select("shard", "_off")), "shard")
    return (s.withColumn("example_id", (F.col("_off") + F.col("pos")).cast("long"))
            .withColumn("rel_path", F.concat_ws("/", F.col("shard").cast("string"),
                                                F.col("file_idx").cast("string")))
            .drop("_off"))


def word_tokens(col) -> Column:
    """Pre-tokens of the lower-cased text (word-level encoder input)."""
    return tx.pretokenize(F.lower(col if isinstance(col, Column) else F.col(col)))


def word_vocab(docs: DataFrame, size: int) -> DataFrame:
    """Word-level vocabulary: specials 0..2 then the ``size - 3`` most common
    pre-tokens (ties by token) - ``vocab(token_id, piece, kind)``."""
    counts = vocab.word_counts(docs, words=word_tokens("text"))
    # a top-k and a window over its rows, at most ``size``: the words are not all put in order
    kept = counts.orderBy(F.col("n").desc(), F.col("word").asc()).limit(max(size - len(vocab.SPECIAL_TOKENS), 0))
    ranked = ordered_running(kept, [F.col("n").desc(), F.col("word").asc()], pos_col="rank", small=True)
    words = ranked.select((F.col("rank") + len(vocab.SPECIAL_TOKENS)).cast("int").alias("token_id"),
                          F.col("word").alias("piece"), F.lit("word").alias("kind"))
    spark = docs.sparkSession
    specials = spark.createDataFrame(
        [(i, s, "special") for i, s in enumerate(vocab.SPECIAL_TOKENS)],
        "token_id int, piece string, kind string")
    return specials.unionByName(words)


def encode_sentences(s: DataFrame, vocab_df: DataFrame, p: ShardParams = ShardParams(),
                     keep_raw: bool = False) -> DataFrame:
    """H6-H8 with a word-level vocabulary (vectorised in-task lookup, no shuffle)."""
    raw = encode.piece_lookup(vocab_df)(word_tokens("sentence"))
    out = s.withColumn("raw_ids", raw)
    out = out.withColumn("ids", encode.fixed_length(F.col("raw_ids"), p.seq_len))
    return out if keep_raw else out.drop("raw_ids")


def token_table(docs: DataFrame, vocab_size: int = 2000, p: ShardParams = ShardParams(),
                keep_raw: bool = False) -> DataFrame:
    """The full P1 plan with the word-level encoder."""
    words = word_vocab(docs, vocab_size)

    def each(s: DataFrame) -> DataFrame:
        # texts are split and encoded once, where they are; ids travel from here on
        return written(encode_sentences(s, words, p, keep_raw=True).drop("sentence", "ids"))
    s = with_example_ids(shard_sentences(docs, p, each), p)
    out = s.withColumn("ids", encode.fixed_length(F.col("raw_ids"), p.seq_len))
    cols = ["shard", "file_idx", "row", "example_id", "rel_path", "ids"]
    return out.select(*cols, "raw_ids") if keep_raw else out.select(*cols)


def encode_sentences_bpe(s: DataFrame, model: bpe.BpeModel, p: ShardParams = ShardParams(),
                         keep_raw: bool = False, hot: int = dictionary.HOT_WORDS) -> DataFrame:
    """E3, E4, H5-H8 with a trained tokenizer; ``s`` has ``example_id`` and ``sentence``."""
    words = tx.pretokenize(tx.normalize("sentence"))
    # written once: the words are counted, then looked up, and no task normalises and looks up at a time
    s = written(s.withColumn("words", words))
    ids = dictionary.build(s, F.col("words"), model)
    out = dictionary.encode(s, "words", ids, ["example_id"], hot=hot).drop("words")
    drop_written(s)
    out = out.withColumn("ids", encode.fixed_length(F.col("raw_ids"), p.seq_len))
    return out if keep_raw else out.drop("raw_ids")


def token_table_bpe(docs: DataFrame, model: bpe.BpeModel, p: ShardParams = ShardParams()) -> DataFrame:
    """The full P1 plan with the trained tokenizer; sentences are sharded and written once."""
    s = written(with_example_ids(shard_sentences(docs, p), p))
    return encode_sentences_bpe(s, model, p).select("shard", "file_idx", "row", "example_id", "rel_path", "ids")

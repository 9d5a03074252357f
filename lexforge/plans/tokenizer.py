"""Corpus -> BPE tokenizer artifact (library semantics).

C1 prefix of the corpus in dataset order -> E3 normalise -> E4 pre-tokenise
-> F1 word counts -> H1 training rounds -> H4 vocabulary -> B7 artifact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import bpe, sampling, vocab
from lexforge.sources import files


def training_words(docs: DataFrame, n_docs: int | None = None) -> DataFrame:
    """``(word, freq)`` of the first ``n_docs`` documents (all when None)."""
    if n_docs is not None:
        docs = sampling.first_rows(docs, "doc_id", n_docs)
    normed = tx.normalize_rows(docs, "text", "norm")
    return vocab.word_counts(normed, words=tx.pretokenize("norm")).select("word", F.col("n").alias("freq"))


def build_tokenizer(docs: DataFrame, vocab_size: int, seq_len: int, out_path: str | None = None,
                    n_docs: int | None = None, min_frequency: int = 5) -> bpe.BpeModel:
    model = bpe.train_library(training_words(docs, n_docs), vocab_size, min_frequency=min_frequency)
    if out_path:
        files.save_tokenizer(docs.sparkSession, model, out_path, seq_len, vocab_size)
    return model

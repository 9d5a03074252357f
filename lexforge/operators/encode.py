"""Encode, unknown mapping, truncate, pad, decode and validation (survey H5-H9, K1).

Vocabulary lookups run inside the task, with no shuffle: the vocabulary is a
model artifact whose size is bounded by the ``vocab_size`` parameter (checked
against ``MAX_VOCAB`` before it is shipped), and each Arrow batch of token
arrays is mapped with one vectorised hash lookup (``pyarrow.compute.index_in``)
in a scalar Arrow UDF.  Spark's own map lookup (``element_at``) scans the
keys linearly, which costs ``vocab_size`` comparisons per token.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.vocab import PAD_ID, UNK_ID

MAX_VOCAB = 5_000_000


def _bounded_rows(vocab: DataFrame, cols: list[str]) -> list:
    rows = vocab.select(*cols).limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"vocabulary larger than {MAX_VOCAB} entries; refusing to ship it to tasks")
    return rows


def _rebuild(lists: pa.Array, values: pa.Array) -> pa.Array:
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(lists.offsets, values, mask=mask)


def piece_lookup(vocab: DataFrame, piece_col: str = "piece", id_col: str = "token_id",
                 unk_id: int = UNK_ID):
    """Return ``f(tokens: array<string>) -> array<int>`` (H6: unknown -> [UNK])."""
    rows = _bounded_rows(vocab, [piece_col, id_col])
    keys = pa.array([r[0] for r in rows], pa.string())
    ids = pa.array([int(r[1]) for r in rows], pa.int32())

    @F.arrow_udf("array<int>")
    def lookup(tokens: pa.Array) -> pa.Array:
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.combine_chunks()
        pos = pc.index_in(tokens.values, value_set=keys)
        mapped = pc.fill_null(pc.take(ids, pos), unk_id)
        return _rebuild(tokens, mapped)
    return lookup


def id_lookup(vocab: DataFrame, piece_col: str = "piece", id_col: str = "token_id"):
    """Return ``f(ids: array<int>) -> array<string>`` (unknown ids -> NULL)."""
    rows = _bounded_rows(vocab, [piece_col, id_col])
    size = max((int(r[1]) for r in rows), default=-1) + 1
    table = [None] * size
    for piece, i in rows:
        table[int(i)] = piece
    pieces = pa.array(table, pa.string())

    @F.arrow_udf("array<string>")
    def lookup(ids: pa.Array) -> pa.Array:
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        v = ids.values
        ok = pc.and_(pc.greater_equal(v, 0), pc.less(v, size))
        safe = pc.if_else(ok, v, 0)
        got = pc.take(pieces, safe) if size else pa.nulls(len(v), pa.string())
        return _rebuild(ids, pc.if_else(ok, got, pa.scalar(None, pa.string())))
    return lookup


def truncate(ids: Column, length: int) -> Column:
    """H7: keep the first ``length`` ids (right side truncated)."""
    return F.slice(ids, 1, length)


def pad(ids: Column, length: int, pad_id: int = PAD_ID) -> Column:
    """H8: right-pad with ``pad_id`` to exactly ``length`` ids."""
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def fixed_length(ids: Column, length: int, pad_id: int = PAD_ID) -> Column:
    """H7 + H8: the tokenizer's truncation and padding settings."""
    return pad(truncate(ids, length), length, pad_id)


def decode(ids: Column, to_pieces, suffix: str = "</w>", sep: str = "",
           n_special: int = 3) -> Column:
    """H9: ids -> text.  Special tokens (ids below ``n_special``) are skipped,
    the end-of-word suffix becomes a space, trailing spaces are removed.
    ``to_pieces`` is an :func:`id_lookup`; ``sep`` joins pieces (``" "`` for a
    word-level vocabulary)."""
    pieces = to_pieces(F.filter(ids, lambda x: x >= n_special))
    return F.rtrim(F.replace(F.array_join(pieces, sep, ""), F.lit(suffix), F.lit(" ")))


def validate_tokens(df: DataFrame, length: int, vocab_size: int, ids_col: str = "ids") -> DataFrame:
    """K1: offending rows with the reason (width != length, or id outside
    ``[0, vocab_size)``).  A null array has the wrong width; a null cell is
    out of range."""
    ids = F.col(ids_col)
    bad_width = F.coalesce(F.array_size(ids) != length, F.lit(True))
    bad_id = F.coalesce(F.exists(ids, lambda x: F.coalesce((x < 0) | (x >= vocab_size), F.lit(True))),
                        F.lit(False))
    reason = (F.when(bad_width & bad_id, F.lit("width,id_range"))
              .when(bad_width, F.lit("width")).when(bad_id, F.lit("id_range")))
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())

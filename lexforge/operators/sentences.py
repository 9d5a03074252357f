"""Sentence split and pre-tokenisation as column jobs (survey E2, E4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx

BLANK_RE = r"^[\t\n\x0B\f\r ]*$"


def split_sentences(df: DataFrame, text_col: str = "text", out_col: str = "sentence",
                    idx_col: str = "sent_idx") -> DataFrame:
    """One row per sentence, in text order, blank pieces dropped.

    Rule: a sentence ends after a run of ``. ! ?`` (plus closing quotes or
    brackets) that is followed by whitespace; the whitespace is consumed.
    Runs entirely inside the task (regex + generator), no shuffle.
    """
    others = [c for c in df.columns if c != text_col]
    exploded = df.select(*others, F.posexplode(tx.sentence_parts(text_col)).alias(idx_col, out_col))
    return (exploded.where(~F.col(out_col).rlike(BLANK_RE))
            .withColumn(idx_col, F.col(idx_col).cast("int")))


def pretokens(df: DataFrame, text_col: str = "text", out_col: str = "token",
              idx_col: str = "tok_idx") -> DataFrame:
    """One row per pre-token (word run / single punctuation / symbol run)."""
    others = [c for c in df.columns if c != text_col]
    return (df.select(*others, F.posexplode(tx.pretokenize(text_col)).alias(idx_col, out_col))
            .withColumn(idx_col, F.col(idx_col).cast("int")))

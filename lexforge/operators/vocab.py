"""Word statistics and vocabulary selection (survey F1, F2, D8, G1, F4, H4)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators.positions import ordered_running

# The reference's coverage target and special tokens.
COVERAGE = 0.90
SPECIAL_TOKENS = ["[UNK]", "[PAD]", "[MASK]"]   # ids 0, 1, 2
UNK_ID, PAD_ID, MASK_ID = 0, 1, 2


def word_counts(corpus: DataFrame, text_col: str = "text", words=None) -> DataFrame:
    """``(word, n)`` over the whole corpus.

    Default word rule is the hand-written cleanup (E5-E8: ASCII fold,
    punctuation and whitespace to spaces, split, case kept).  Partial
    aggregation runs map-side, so only one row per distinct word per task
    is shuffled.
    """
    words = words if words is not None else tx.clean_words(text_col)
    return (corpus.select(F.explode(words).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def most_common(counts: DataFrame, checkpoint: bool = True) -> DataFrame:
    """D8 + G1 inputs: rank (0-based) by ``n desc, word asc`` and the
    exclusive running total of ``n`` in that order (``n_before``)."""
    return ordered_running(counts, [F.col("n").desc(), F.col("word").asc()],
                           pos_col="rank", sums={"n_before": "n"}, checkpoint=checkpoint)


def corpus_totals(counts: DataFrame) -> DataFrame:
    """total word occurrences and distinct words."""
    return counts.agg(F.sum("n").cast("long").alias("total_words"),
                      F.count(F.lit(1)).alias("distinct_words"))


def coverage_cut(counts: DataFrame, coverage: float = COVERAGE,
                 checkpoint: bool = True) -> DataFrame:
    """G1: the smallest most-common-first word list whose share reaches
    ``coverage`` (the crossing word is included).

    A word is kept iff the words strictly before it cover less than the
    target: ``n_before < coverage * total``.  The comparison is exact: the
    coverage as a reduced fraction, the counts as 28-digit decimals, which
    hold the products at any corpus size.
    """
    share = Fraction(str(coverage)).limit_denominator(1_000_000)
    ranked = most_common(counts, checkpoint=checkpoint)
    # scalar subquery over the checkpointed ranking: computed once, inlined,
    # no join and no second pass over the corpus
    total = ranked.agg(F.sum("n")).scalar()
    wide = "decimal(28,0)"
    return ranked.where(F.col("n_before").cast(wide) * share.denominator
                        < total.cast(wide) * share.numerator)


def alphabet(words: DataFrame, initial: str, limit: int, word_col: str = "word",
             freq_col: str | None = None) -> DataFrame:
    """character counts (weighted by word frequency) plus the fixed initial
    alphabet; the initial characters always rank first (even when absent from
    the data), then by count.  ``kept`` marks the first ``limit`` characters.
    Output ``(ch, n, in_alphabet, kept)`` - one row per distinct character."""
    from pyspark.sql import Window
    spark = words.sparkSession
    w = F.col(freq_col) if freq_col else F.lit(1)
    counts = (words.select(F.explode(tx.chars(word_col)).alias("ch"), w.alias("_w"))
              .groupBy("ch").agg(F.sum("_w").cast("long").alias("n")))
    init = spark.createDataFrame([(c, True) for c in sorted(set(initial))], "ch string, in_alphabet boolean")
    allc = (counts.join(init, "ch", "full_outer")
            .withColumn("in_alphabet", F.coalesce(F.col("in_alphabet"), F.lit(False)))
            .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long"))))
    # one row per distinct character: bounded by the size of Unicode
    order = Window.orderBy(F.col("in_alphabet").desc(), F.col("n").desc(), F.col("ch"))
    return allc.withColumn("kept", F.row_number().over(order) <= limit)

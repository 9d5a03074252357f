"""Text column expressions (survey E1-E10).

All of these are built-in Spark expressions (JVM side, whole-stage codegen)
except ``normalize``, which needs Unicode NFKD and is one pass of vectorised
Arrow kernels.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ASCII punctuation = Python's string.punctuation (32 characters):
#   !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
# ASCII whitespace = Python's string.whitespace (6 characters): space \t \n \r \x0b \x0c
# Lower-case letters a-z and digits 0-9 complete the 74-character BPE alphabet.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITESPACE = " \t\n\r\x0b\x0c"
ALPHANUMERIC = "abcdefghijklmnopqrstuvwxyz0123456789"
ALPHABET = PUNCTUATION + WHITESPACE + ALPHANUMERIC
# Regex classes (valid in both Java regex and RE2).
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
# str.split() also splits on the ASCII separators \x1c-\x1f.
SPLIT_WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F ]"
# Pre-tokenizer: word runs, single punctuation marks, runs of other symbols.
PRETOKEN_RE = (r"[\p{L}\p{N}\p{M}]+|[!-/:-@\[-`{-~\p{P}]"
               r"|[^\p{L}\p{N}\p{M}\p{P}\s!-/:-@\[-`{-~]+")
# A sentence: up to terminal marks, closing quotes/brackets and the whitespace
# after them, or up to the end (possessive: read once, forward).
SENTENCE_RE = (r"(?!\z)((?:[^.!?]++|[.!?][\"')\]]*+(?![\t\n\x0B\f\r ]))*+(?:[.!?][\"')\]]*+)?)"
               r"[\t\n\x0B\f\r ]*+")
# End-of-word suffix of the library tokenizer path.
EOW_SUFFIX = "</w>"
# Characters with the Unicode White_Space property (what the normaliser's
# strip removes; \x1c-\x1f are not among them).
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold_newlines(col) -> Column:
    """Every newline becomes one space."""
    return F.translate(_c(col), "\n", " ")


def sentence_parts(col) -> Column:
    """E2 helper: array of sentence strings (blank pieces still included)."""
    return F.regexp_extract_all(_c(col), F.lit(SENTENCE_RE), 1)


def ascii_fold(col) -> Column:
    """E5: drop every non-ASCII character."""
    return F.regexp_replace(_c(col), r"[^\x00-\x7F]", "")


def punct_to_space(col) -> Column:
    """Each of the 32 ASCII punctuation characters becomes a space."""
    return F.regexp_replace(_c(col), PUNCT_CLASS, " ")


def whitespace_fold(col) -> Column:
    """Runs of ASCII whitespace become a single space."""
    return F.regexp_replace(_c(col), r"[ \t\n\r\x0B\f]+", " ")


def clean_ascii(col) -> Column:
    """E5 -> E6 -> E7 as one expression chain."""
    return whitespace_fold(punct_to_space(ascii_fold(col)))


def split_words(col) -> Column:
    """``str.split()`` - whitespace-separated words, case kept, no empties."""
    return F.filter(F.split(F.trim(_c(col)), SPLIT_WS_CLASS + "+"), lambda w: w != "")


def clean_words(col) -> Column:
    """E5-E8 fused: maximal runs of ASCII characters that are neither
    punctuation nor whitespace (identical to cleaning then splitting)."""
    return F.regexp_extract_all(ascii_fold(col),
                                F.lit(r"[^!-/:-@\[-`{-~\t\n\x0B\f\r\x1C-\x1F ]+"), 0)


def pretokenize(col) -> Column:
    """Whitespace split + isolated punctuation, as one regex extraction."""
    return F.regexp_extract_all(_c(col), F.lit(PRETOKEN_RE), 0)


def chars(col) -> Column:
    """Code points of a string (astral characters stay whole)."""
    return F.regexp_extract_all(_c(col), F.lit(r"(?s)."), 0)


def end_of_word_symbols(col, eow: str = EOW_SUFFIX) -> Column:
    """Initial BPE symbols of a word.

    ``eow='</w>'`` (library mode) fuses the suffix with the last character;
    ``eow=' '`` (hand-written mode) appends one extra space symbol.
    """
    cs = chars(col)
    if eow == " ":
        return F.concat(cs, F.array(F.lit(" ")))
    # no lambda: a per-row expression inside a lambda is re-evaluated per element
    n = F.size(cs)
    return F.when(n > 0, F.concat(F.slice(cs, 1, n - 1),
                                  F.array(F.concat(F.element_at(cs, -1), F.lit(eow))))).otherwise(cs)


def seconds_to_mmss(col) -> Column:
    """``mm:ss`` with unbounded minutes (floor semantics)."""
    s = _c(col).cast("double")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"),
                           F.floor(F.pmod(s, F.lit(60.0))).cast("long"))


# --- E3 normalisation -------------------------------------------------------

@F.arrow_udf(T.StringType())
def _normalize_udf(s: pa.Array) -> pa.Array:
    if isinstance(s, pa.ChunkedArray):
        s = s.combine_chunks()
    s = pc.replace_substring(pc.utf8_normalize(s, form="NFKD"), "\n", " ")
    s = pc.replace_substring_regex(pc.utf8_lower(s), r"\p{M}", "")
    return pc.utf8_trim(s, characters=WHITE_SPACE)


def normalize(col) -> Column:
    """E3 as one column expression and one vectorised Arrow pass: NFKD ->
    newline to space -> lowercase (each character alone) -> strip all marks
    -> strip white space."""
    return _normalize_udf(_c(col))


def normalize_rows(df, col: str, out: str):
    """E3 on a DataFrame, in one scan."""
    return df.withColumn(out, normalize(col))

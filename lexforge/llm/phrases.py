"""Phrase collocations from count streams in prefix and suffix order.

Texts are cut into pieces and words, and the contiguous phrases of up to
``max_words`` words of each language are counted:

1. words, all of them: their sums per language and the frequent ones;
2. pairs of frequent words, then longer phrases of such pairs, as hashes.  A
   hash counts at least as often as each of its phrases, so what stays below
   ``min_count`` is safely left out;
3. phrases whose hashes all passed, by their exact words.  A task sums its
   slices first and takes up to ``SPLITS`` splits of the input, where there are
   more than cores.  It passes a phrase on once, not once a slice or a split,
   unless its counts reach ``HELD`` bytes.

A phrase occurs no more often than any phrase inside it, so nothing frequent is
lost.  What tasks hold of steps 1 and 2 are bit maps of a fixed size
(``bits``): as they fill up, step 3 leaves out less, and counts the same.

The counts of each length are one stream.  In prefix order (by all words but
the last) it meets the stream of the shorter phrases in a sort-merge join and
inherits the counts of all its beginnings; in suffix order (by all words but
the first) those of all its endings.  The same two orders give each phrase its
largest extension by one word; a longer one cannot be more frequent.  AQE
splits the keys of very frequent words.

Defined results: a null text has no words; a null language is ``und``, together
with documents that say ``und``; repeated rows count as often as they stand;
without frequent phrases, or rows, the result is empty; equal scores are ordered
by count, then by phrase in byte order.  Columns other than the two named are
never read, whatever their names.  Texts are read whole, a slice at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import small_batches, written

SLICE = 1 << 21      # bytes of text handled at once; a piece is never cut
HELD = 96 << 20      # bytes of summed counts that a task holds, about
SPLITS = 8           # splits of the input whose phrases a task counts together, at most
_FOLD = bytearray(range(256))
_FOLD[0x41:0x5B] = range(0x61, 0x7B)
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 0x0A                 # all piece borders
_FOLD[0x09] = 0x20
_FOLD = bytes(_FOLD)
_GRAM = "lang string, phrase string, f long"


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, folded text) of about SLICE bytes, cut at piece borders only."""
    of_lang: dict[str, list[bytes]] = defaultdict(list)
    held: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            folded = (text or b"").translate(_FOLD)
            lo = 0
            while lo < len(folded):
                hi = len(folded) if len(folded) - lo <= SLICE else folded.find(b"\n", lo + SLICE)
                hi = len(folded) if hi < 0 else hi
                of_lang[lang].append(folded[lo:hi])
                held[lang] += hi - lo
                lo = hi + 1
                if held[lang] >= SLICE:
                    yield lang, b"\n".join(of_lang.pop(lang))
                    held.pop(lang)
        if sum(held.values()) > 4 * SLICE:          # many languages
            for lang, parts in of_lang.items():
                yield lang, b"\n".join(parts)
            of_lang.clear(), held.clear()
    for lang, parts in of_lang.items():
        yield lang, b"\n".join(parts)


def _numbered(folded: bytes) -> tuple[list[bytes], np.ndarray, list[bytes], int]:
    """Words and borders in order, their numbers, the distinct ones, and the border's number."""
    number = defaultdict()
    number.default_factory = number.__len__
    border, blank = number[b"\n"], number[b""]
    words = folded.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    number.default_factory = None        # it holds the dict, which would stay until a garbage collection
    keep = ids != blank
    return [w for w in words if w], ids[keep], list(number), border


def _word_hashes(lang: str, distinct: list[bytes]) -> np.ndarray:
    salt = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in distinct), dtype=np.uint64, count=len(distinct))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of a phrase and the word after it."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, set at the top bits of each ``h``; at most 2**bits / 64 rows reach the driver."""
    bit = F.shiftrightunsigned("h", 64 - bits)
    rows = (hashes.groupBy(F.shiftrightunsigned(bit, 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("set"))
            .toPandas())
    out = np.zeros(max(1, (1 << bits) // 64), dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["set"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _rows(lang: str, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
         pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def _by_task(counts: Iterable[tuple[str, list[bytes], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's slices summed by phrase, passed on when they reach about HELD bytes."""
    sums: dict[str, dict[bytes, int]] = defaultdict(dict)
    size = 0
    for lang, phrases, n in counts:
        of = sums[lang]
        for phrase, f in zip(phrases, n.tolist()):
            if phrase in of:
                of[phrase] += f
            else:
                of[phrase] = f
                size += len(phrase) + 100
        if size >= HELD:
            yield from _rows_of(sums)
            size = 0
    yield from _rows_of(sums)


def _rows_of(sums: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    while sums:
        lang, of = sums.popitem()
        rest = iter(of.items())
        while part := list(islice(rest, 1 << 16)):
            yield _rows(lang, [p for p, _ in part], np.array([f for _, f in part], dtype=np.int64))


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, folded in _slices(batches):
        _, ids, distinct, border = _numbered(folded)
        n = np.bincount(ids, minlength=len(distinct))
        n[border] = 0
        some = np.flatnonzero(n)
        yield _rows(lang, [distinct[i] for i in some.tolist()], n[some])


def _pairs(lang: str, ids: np.ndarray, distinct: list[bytes], border: int, frequent: np.ndarray):
    """(starts, hashes) of the pairs of frequent words inside a piece, and all words' hashes."""
    h = _word_hashes(lang, distinct)
    good = _has(frequent, h)
    good[border] = False
    at = np.flatnonzero(good[ids[:-1]] & good[ids[1:]])
    return at, _joined(h[ids[at]], h[ids[at + 1]]), h[ids]


def _packed(h: list[np.ndarray], n: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Distinct hashes with their counts in the last ``bits`` bits; counts stop at what these hold."""
    low = np.uint64((1 << bits) - 1)
    keys, at = np.unique(np.concatenate(h) & ~low, return_inverse=True)
    count = np.bincount(at, weights=np.concatenate(n), minlength=len(keys))
    packed = keys | np.minimum(count, float(low)).astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(packed.view(np.int64))], names=["packed"])


def _count_hashes(hashes, bits: int):
    """Counts of the hashes of each slice, folded over the task about 4 million at a time."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for lang, folded in _slices(batches):
            h, n = np.unique(hashes(lang, *_numbered(folded)[1:]), return_counts=True)
            keys.append(h), counts.append(n)
            held += len(h)
            if held > 4_000_000:
                yield _packed(keys, counts, bits)
                keys, counts, held = [], [], 0
        if keys:
            yield _packed(keys, counts, bits)
    return count


def _frequent_hashes(docs: DataFrame, hashes, min_count: int) -> DataFrame:
    """(h) of the hashes that count ``min_count`` or more in all; the last bits of h are 0."""
    bits = max(8, min_count.bit_length())          # so that a capped count is enough by itself
    packed = docs.mapInArrow(_count_hashes(hashes, bits), "packed long")
    key = F.shiftright("packed", bits)
    # one column to shuffle; counts are folded by task already
    return (packed.repartition(key).select(key.alias("key"), F.col("packed").bitwiseAND((1 << bits) - 1).alias("f"))
            .groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
            .select(F.shiftleft("key", bits).alias("h")))


def _pair_hashes(frequent):
    def hashes(lang: str, ids: np.ndarray, distinct: list[bytes], border: int) -> np.ndarray:
        return _pairs(lang, ids, distinct, border, frequent.value)[1]
    return hashes


def _longer_hashes(frequent, linked, max_words: int):
    """Hashes of phrases of 3 words and more whose pairs may all be frequent."""
    def hashes(lang: str, ids: np.ndarray, distinct: list[bytes], border: int) -> np.ndarray:
        at, own, word = _pairs(lang, ids, distinct, border, frequent.value)
        keep = _has(linked.value, own)
        at, own = at[keep], own[keep]
        joined = np.zeros(len(ids) + max_words, dtype=bool)
        joined[at] = True
        out = [own[:0]]
        for m in range(3, max_words + 1):
            more = joined[at + m - 2]
            at, own = at[more], own[more]
            own = _joined(own, word[at + m - 1])
            out.append(own)
        return np.concatenate(out)
    return hashes


def _count_phrases(frequent, linked, longer, max_words: int):
    """Exact counts of phrases of 2 words and more that may be frequent."""
    def by_slice(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang, folded in _slices(batches):
            words, ids, distinct, border = _numbered(folded)
            at, h, word = _pairs(lang, ids, distinct, border, frequent.value)
            keep = _has(linked.value, h)
            at, h = at[keep], h[keep]
            own = ids[at]                         # number of the phrase so far, by its start
            for m in range(2, max_words + 1):
                if m > 2:
                    at, own, h = at[inside := at + m - 1 < len(ids)], own[inside], h[inside]
                    h = _joined(h, word[at + m - 1])
                    keep = _has(longer.value, h)
                    at, own, h = at[keep], own[keep], h[keep]
                if not len(at):
                    break
                _, first, own, n = np.unique(own * len(distinct) + ids[at + m - 1], return_index=True,
                                             return_inverse=True, return_counts=True)
                starts = at[first]
                inner = ids[starts[:, None] + np.arange(m)]
                real = (inner != border).all(axis=1)     # a hash may be frequent by chance
                yield lang, [b" ".join(words[i:i + m]) for i in starts[real].tolist()], n[real]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_task(by_slice(batches))
    return count


def _hashed(words: DataFrame) -> DataFrame:
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [xxhash.xxh3_64_intdigest(w.encode(), xxhash.xxh3_64_intdigest(lang.encode()))
                 for lang, w in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, dtype=np.uint64).view(np.int64))], names=["h"])
    return words.select("lang", "phrase").mapInArrow(of, "h long")


def count_phrases(docs: DataFrame, max_words: int, min_count: int, word_bits: int = 24,
                  pair_bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases that occur ``min_count`` times, and (lang, n) of all words.

    ``docs`` has lang (not null) and text (binary).
    """
    sc = docs.sparkSession.sparkContext
    words = written(docs.mapInArrow(_count_words, _GRAM).groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    singles = words.where(F.col("f") >= min_count)
    frequent = sc.broadcast(_bitmap(_hashed(singles), word_bits))
    linked = sc.broadcast(_bitmap(_frequent_hashes(docs, _pair_hashes(frequent), min_count), pair_bits))
    longer = sc.broadcast(_bitmap(
        _frequent_hashes(docs, _longer_hashes(frequent, linked, max_words), min_count), pair_bits))
    tasks = max(sc.defaultParallelism, -(-docs.rdd.getNumPartitions() // SPLITS))
    phrases = (docs.coalesce(tasks).mapInArrow(_count_phrases(frequent, linked, longer, max_words), _GRAM)
               .groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count))
    return written(singles.unionByName(phrases).select("lang", F.split("phrase", " ").alias("words"), "f")), total


def _prefix(words: str):
    return F.slice(words, 1, F.size(words) - 1)


def _suffix(words: str):
    return F.slice(words, 2, F.size(words) - 1)


def _chained(counts: DataFrame, max_words: int) -> DataFrame:
    """(lang, words, f, lefts, rights): counts of all beginnings, short to long, and of all endings."""
    of = [counts.where(F.size("words") == m) for m in range(1, max_words + 1)]
    empty = F.array().cast("array<bigint>")
    shorter = of[0].withColumns({"lefts": empty, "rights": empty})
    out = []
    for m in range(2, max_words + 1):
        stream = of[m - 1].withColumns({"_first": _prefix("words"), "_rest": _suffix("words")})
        left = shorter.select("lang", F.col("words").alias("_first"), F.concat("lefts", F.array("f")).alias("lefts"))
        right = shorter.select("lang", F.col("words").alias("_rest"), F.concat("rights", F.array("f")).alias("rights"))
        shorter = (stream.join(left.hint("merge"), ["lang", "_first"])
                   .join(right.hint("merge"), ["lang", "_rest"]).drop("_first", "_rest"))
        if m < max_words:
            shorter = written(shorter)            # read twice by the next length
        out.append(shorter)
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def _wide(col: str):
    """Counts as decimals of 20 digits: their products with parameters stay exact."""
    return F.col(col).cast("decimal(20,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 4,
                 min_count: int = 30, contained_percent: int = 80, scale: int = 2_000_000,
                 top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words, extended): the best ``top`` phrases of each language.

    A phrase that occurs a times scores floor(scale * a / (l + r)) at its worst
    cut, l and r the counts of the two sides.  It is dropped where an extension
    holds ``contained_percent`` of its occurrences.  ``extended`` is the largest
    count of an extension by one word, 0 without any.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        counts, total = count_phrases(texts, max_words, min_count)
    phrases = _chained(counts, max_words)
    longer = counts.where(F.size("words") > 2)
    ends = longer.select("lang", _prefix("words").alias("words"), "f").unionByName(
        longer.select("lang", _suffix("words").alias("words"), "f"))
    extended = ends.groupBy("lang", "words").agg(F.max("f").alias("extended"))
    found = (phrases.join(extended.hint("merge"), ["lang", "words"], "left")
             .withColumn("extended", F.coalesce("extended", F.lit(0).cast("long")))
             .where(_wide("extended") * 100 < _wide("f") * contained_percent))

    m = F.size("words")
    cuts = F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.struct(
        F.element_at("lefts", k).alias("l"), F.element_at("rights", m - k).alias("r"), k.alias("k")))
    cuts = F.transform(cuts, lambda c: F.struct(
        F.call_function("div", F.col("f").cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"),
                        c["l"].cast("decimal(20,0)") + c["r"]).cast("long").alias("score"),
        c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    found = found.withColumn("cut", F.array_min(cuts)).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r",
        "cut.score", "words", "extended")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", place).where(F.col("rank") <= top)
    # one row per language on the right; ranks are cut before it
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words", "extended")

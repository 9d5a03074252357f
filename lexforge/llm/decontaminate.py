"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are built into a suffix automaton, which is
broadcast; documents stream through it on the executors, keeping at each word
the longest matching length.  Every window of ``window`` consecutive item
words inside a match (or a shorter item found whole) is a hit.  Nothing is
shuffled and no document key is needed, so repeated or null ids are harmless.

Memory does not grow with the benchmark: items are dealt into blocks of about
``block_words`` words by a hash and read block by block; the automata of
``at_once`` blocks, some 60 MB each at 100,000 words, are broadcast, the documents
pass through them in one scan, and with more blocks to come what was found is
written and the broadcasts are dropped before the next ones are built.

Defined results: a null or empty text has no words and no hits; a null or
wordless item has no windows; an item with a null id marks words but is not
counted; items that share an id count once; input columns that clash with an
output column are replaced by it; empty tables give empty results or no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexforge.llm.automaton import SuffixAutomaton, merged
from lexforge.llm.common import bounded_batches, discard, free_name, without, written
from lexforge.llm.tokens import ALNUM, Tokens, chunks
from lexforge.session import checkpoint_dir

OUTPUT = ("n_words", "spans", "items", "n_hit")
_TYPE = "n_words long, spans array<array<long>>, items array<string>"


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[bool, list]]:
    """(last one, (id as string, words) of a block of about ``block_words`` words)."""
    rows = items.select(F.col(id_col).cast("string").alias("id"),
                        F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // (8 * block_words)))      # about 8 bytes a word
    if n_blocks > 1:                                       # each block is read once
        spark = items.sparkSession
        path = f"{checkpoint_dir(spark).rstrip('/')}/items-{uuid.uuid4().hex}"
        (rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
         .write.partitionBy("block").parquet(path))
        rows = spark.read.schema("id string, text binary, block long").parquet(path)
    for b in range(n_blocks):
        part = rows.where(F.col("block") == b) if n_blocks > 1 else rows
        block = [(r.id, bytes(r.text or b"")) for r in part.toLocalIterator()]
        t = Tokens([text for _, text in block], ALNUM, True)
        yield b == n_blocks - 1, [(key, t.words(t.first[i], t.first[i + 1])) for i, (key, _) in enumerate(block)]


def _scan(automaton) -> object:
    @F.pandas_udf(_TYPE)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        a = automaton.value
        for text, spans, items in batches:
            n_words, all_spans, all_items = [], [], []
            blobs = text.tolist()
            for lo, hi, t in chunks(blobs, ALNUM, True):
                found: dict[int, tuple[list, set]] = {}
                for s, e, names in a.hits(t):
                    at, keys = found.setdefault(int(t.doc[s]), ([], set()))
                    first = int(t.first[t.doc[s]])
                    at.append((s - first, e - first))
                    keys |= names
                for d in range(hi - lo):
                    n_words.append(int(t.first[d + 1] - t.first[d]))
                    at, keys = found.get(d, ([], set()))
                    old = [tuple(x) for x in spans.iloc[lo + d]]
                    all_spans.append(merged(old + at))
                    all_items.append(sorted({x for x in keys if x is not None} | set(items.iloc[lo + d])))
            yield pd.DataFrame({"n_words": n_words, "spans": all_spans, "items": all_items})
    return scan


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10,
                       text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text", block_words: int = 100_000, at_once: int = 2) -> DataFrame:
    """``docs`` with n_words, spans (half-open word ranges hit), items (sorted ids) and n_hit."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = without(docs, [c for c in OUTPUT if c != text_col.lower()])
    found = free_name(out, "_found")
    state = F.struct(F.lit(0).cast("long").alias("n_words"),
                     F.array().cast("array<array<long>>").alias("spans"),
                     F.array().cast("array<string>").alias("items"))
    out = out.withColumn(found, state)
    held, table = [], None
    for last, block in item_blocks(items, item_id, item_text, block_words):
        held.append(spark.sparkContext.broadcast(
            SuffixAutomaton([w for _, w in block], [k for k, _ in block], window)))
        out = out.withColumn(found, _scan(held[-1])(F.col(text_col).cast("binary"), F.col(f"{found}.spans"),
                                                    F.col(f"{found}.items")))
        if len(held) == at_once and not last:
            before, table = table, written(out)
            out = table
            for b in held:
                b.destroy()
            held = []
            if before is not None:
                discard(before)
    n_hit = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return out.select("*", f"{found}.*").drop(found).withColumn("n_hit", n_hit)


@F.pandas_udf(StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for raw, drop in zip(text.tolist(), spans):
        if raw is None or not len(drop):
            out.append(None if raw is None else raw.decode("utf-8", "replace"))
            continue
        t, keep, at = Tokens([raw], ALNUM, True), [], 0
        for s, e in drop:
            keep.append(raw[at:t.start[s]])
            at = int(t.end[e - 1])
        out.append(b"".join([*keep, raw[at:]]).decode("utf-8", "replace"))
    return pd.Series(out, dtype=object)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, min_span: int = 10,
                  max_coverage: float = 0.5, text_col: str = "text", **kw) -> DataFrame:
    """Remove hit spans of at least ``min_span`` words from the texts, and drop
    documents of which more than ``max_coverage`` of the words are hit.

    Adds the columns of :func:`find_contamination`; the text column holds the
    text without the removed spans.
    """
    found = find_contamination(docs, items, window, text_col, **kw)
    long_spans = F.filter("spans", lambda x: x[1] - x[0] >= min_span)
    return (found.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage))
            .withColumn(text_col, _cut(F.col(text_col).cast("binary"), long_spans)))


def contamination_digest(found: DataFrame) -> list[Column]:
    """The digest columns of the registered query, from ``find_contamination``."""
    return [F.col("n_words"), F.col("n_hit"), F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated")]

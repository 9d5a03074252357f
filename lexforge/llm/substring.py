"""Substring dedup: repeated windows found in content-defined blocks.

The method dealt is a relative Lempel-Ziv parse with greedy longest factors;
this is not one.  What has to go is the union of all repeated windows, and
windows hashed under their anchors give exactly that without a parse.

The reference of a document is every document with a smaller id.  All texts
are cut into *blocks*: maximal runs of windows (``window`` consecutive words)
with the same anchor, the smallest hash among the ``window - anchor + 1``
anchor n-grams of the window.  A window has its anchor wherever it stands, so
a window of one document can only occur in blocks that the same anchor
indexes, and no document needs to be parsed against any other block.

1. Blocks are shuffled once, by anchor.  A block whose whole content occurs in
   a smaller document is a factor as it stands.  Where that document lies in
   the same batch, the block is settled before the shuffle and dealt out by
   place, so of a passage that many documents share one block a batch meets.
2. Blocks seen first in their document, under an anchor that also has other
   contents, are parsed window by window: each such distinct block sends its
   windows, and those that also start in a smaller document are factors.
3. Factors of a document are joined at their boundaries: windows run across
   block borders (neighbouring blocks overlap by window - 1 words), so the
   union of the factors is exactly every word covered by a repeated window.

Only runs, never texts, meet in the shuffles of steps 1 and 2 (besides the one
exchange of texts by id that steps 2 and 3 share).

Defined results: a null text has no words; a text shorter than the window
loses nothing; ids are integers; rows with equal ids are not smaller than each
other; a null id is larger than every other; hashes of blocks and windows count together with
their anchors, 128 bits in all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.automaton import merged
from lexforge.llm.common import written
from lexforge.llm.tokens import _R, _R_INV, SPACE, Tokens, _powers, chunks, salted

NO_ID = 2**63 - 1        # stands for a null id inside: larger than every other


def _anchored(t: Tokens, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, anchor hash, places) of all windows that lie in one text."""
    w, at = t.grams(window)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), at
    a, _ = t.grams(anchor)
    a = salted(a, 1)
    least = a[:len(w)].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(least, a[j:j + len(w)], out=least)
    return w[at], least[at], at


def _blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, content, n, id, tag, start, known): every block of every document; known: its
    content is in a smaller document of the batch."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, tags = batch["id"].to_numpy(), batch["tag"].to_numpy()
            for lo, _, t in chunks(batch["text"].tolist(), SPACE, False):
                w, a, at = _anchored(t, window, anchor)
                if not len(at):
                    continue
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
                                      | (t.doc[at[1:]] != t.doc[at[:-1]])))
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(a)))
                total = np.zeros(len(w) + 1, dtype=np.uint64)
                np.cumsum(salted(w, 2) * _powers(_R, len(w))[:len(w)], out=total[1:])
                content = (total[first + n] - total[first]) * _powers(_R_INV, len(w))[first]
                doc = t.doc[at[first]]
                found = pd.DataFrame({"anchor": a[first].view(np.int64), "content": content.view(np.int64),
                                      "n": n.astype(np.int32), "id": ids[lo + doc], "tag": tags[lo + doc],
                                      "start": (at[first] - t.first[doc]).astype(np.int32)})
                found["known"] = found["id"] > found.groupby(["anchor", "content"])["id"].transform("min")
                yield found
    return docs.mapInPandas(cut, "anchor long, content long, n int, id long, tag int, start int, known boolean")


def _windows(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(hash, anchor, id, tag, start, known) of the windows in the listed runs of each text."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, tags, runs = batch["id"].to_numpy(), batch["tag"].to_numpy(), batch["runs"]
            for lo, hi, t in chunks(batch["text"].tolist(), SPACE, False):
                w, a, at = _anchored(t, window, anchor)
                pick, doc = [], []
                for d in range(hi - lo):
                    for run in runs.iloc[lo + d]:
                        s = int(np.searchsorted(at, t.first[d] + run["start"]))
                        pick.append(np.arange(s, s + run["n"]))
                        doc.append(np.full(run["n"], d))
                pick = np.concatenate(pick) if pick else np.empty(0, np.int64)
                doc = np.concatenate(doc) if doc else np.empty(0, np.int64)
                found = pd.DataFrame({"hash": w[pick].view(np.int64), "anchor": a[pick].view(np.int64),
                                      "id": ids[lo + doc], "tag": tags[lo + doc],
                                      "start": (at[pick] - t.first[doc]).astype(np.int32)})
                # map-side combine: a smaller id in this very batch settles a window
                found["known"] = found["id"] > found.groupby(["hash", "anchor"])["id"].transform("min")
                yield found
    return texts.mapInPandas(cut, "hash long, anchor long, id long, tag int, start int, known boolean")


def _runs_of(rows: DataFrame) -> DataFrame:
    # a set: repeated rows share one key and have the same runs
    return (rows.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
            .withColumnsRenamed({"id": "_id", "tag": "_tag"}))


def duplicate_spans(docs: DataFrame, window: int = 13, anchor: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, tag, text as binary, runs): runs of windows (start, n) that also start
    in a document with a smaller id; null where a document has none.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    docs = docs.select(ids.alias("id"), F.col(text_col).cast("binary").alias("text"))
    docs = docs.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    # one exchange of blocks: both windows run on its partitions by anchor; known blocks need no partner
    alone = F.when(F.col("known"), F.xxhash64("id", "tag", "start")).otherwise(F.lit(0))
    same = Window.partitionBy("anchor", "alone", "content")
    under = Window.partitionBy("anchor", "alone")
    blocks = _blocks(docs, window, anchor).withColumn("alone", alone).repartition("anchor", "alone")
    blocks = (blocks.withColumn("least", F.min("id").over(same))
              .withColumns({"lo": F.min("content").over(under), "hi": F.max("content").over(under)})
              .withColumn("whole", F.col("known") | (F.col("least") < F.col("id"))).where("whole or lo != hi"))
    blocks = written(blocks.select("whole", "id", "tag", "start", "n"))

    texts = docs.select("id", "tag", "text").repartition("id", "tag")
    key = (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag"))
    first = _runs_of(blocks.where("not whole"))
    parsed = _windows(texts.join(first, key).select("id", "tag", "text", "runs"), window, anchor)
    # settled rows need no partner: they are dealt out by place instead of by window
    alone = F.when(F.col("known"), F.xxhash64("id", "tag", "start")).otherwise(F.lit(0))
    window_key = Window.partitionBy("hash", "anchor", "alone")
    parsed = (parsed.withColumn("alone", alone).withColumn("least", F.min("id").over(window_key))
              .where(F.col("known") | (F.col("least") < F.col("id"))).select("id", "tag", "start", F.lit(1).alias("n")))
    factors = _runs_of(blocks.where("whole").select("id", "tag", "start", "n").unionByName(parsed))
    return (texts.join(factors, key, "left")
            .select(F.nullif("id", F.lit(NO_ID)).alias("id"), "tag", "text", "runs"))


def remove_duplicates(docs: DataFrame, window: int = 13, anchor: int = 5, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept): kept words joined by one space, and
    the removed spans as half-open word ranges.
    """
    @F.pandas_udf("n_words long, n_removed long, spans array<array<long>>, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, runs in batches:
            rows = []
            for lo, hi, t in chunks(text.tolist(), SPACE, False):
                for d in range(hi - lo):
                    a, b = int(t.first[d]), int(t.first[d + 1])
                    found = runs.iloc[lo + d]
                    spans = merged([(r["start"], r["start"] + r["n"] + window - 1) for r in found]
                                   if found is not None else [])
                    keep, at = [], a
                    for s, e in spans:
                        keep += t.words(at, a + s)
                        at = a + e
                    keep += t.words(at, b)
                    rows.append((b - a, sum(e - s for s, e in spans), spans, b" ".join(keep)))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "spans", "kept"])

    found = duplicate_spans(docs, window, anchor, id_col, text_col)
    return found.select(F.col("id").alias(id_col), cut("text", "runs").alias("r")).select(id_col, "r.*")

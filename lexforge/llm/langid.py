"""Language ID: nearest of several clustered centroids per language, by cosine.

Features are hashed byte 2- and 3-grams of the lower-cased letters (2**13
dimensions), weighted by log term frequency and inverse document frequency,
normalised.  Document frequencies count all training rows.  The centroids come
from spherical k-means on at most ``per_language`` training rows of each
language, drawn by a seeded hash (the documented bound of the fit); each
language is fitted in its own task, and centroids x languages x dimensions is
what gets broadcast.  Whole texts are read everywhere.

A row is rejected when its text is null or has no letter (``und``), or when the
nearest centroid is too far.  Long texts lie nearer to their centroid than
short ones, so the limit depends on the length class (powers of two of the
bytes): ``reach`` times the cosine that 99% of the fitted rows of the class
have.  A class of fewer than 30 fitted rows takes the limit of the next smaller
class that has one.  Texts below 63 bytes say too little for that; theirs, as
that of classes below all that have rows, is a tenth of the mean cosine of the
centroid's own members.

Defined results: without any training row, or in an empty table, every text is
``und``; equal cosines go to the language first in order; score lies in [0, 1];
rows that repeat an id are drawn by id and text, equal rows alike; texts are
read whole, batches are bound by bytes; input columns that clash with an output
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import bounded_batches, free_name, seeded_hash, without

DIM = 1 << 13
SHORT = 6            # length classes below are short texts
_CODE = np.arange(256, dtype=np.uint64)
_CODE[0x41:0x5B] += np.uint64(32)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_CODE[~_LETTER] = 0x20
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _batches(blobs: list, max_bytes: int = 1 << 18, max_texts: int = 32) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, b in enumerate(blobs):
        n = len(b or b"")
        if i > lo and (size + n > max_bytes or i - lo >= max_texts):
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(blobs):
        yield lo, len(blobs)


def counts(blobs: list) -> np.ndarray:
    """texts x DIM counts of hashed 2- and 3-grams."""
    parts = [b" " + (b or b"") + b" " for b in blobs]
    code = _CODE[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~((code[1:] == 0x20) & (code[:-1] == 0x20) & (doc[1:] == doc[:-1]))
    code, doc = code[keep], doc[keep]
    out = np.zeros(len(parts) * DIM, dtype=np.float32)
    acc = code * _MULT[0]
    for n in (2, 3):
        acc = acc[:-1] + code[n - 1:] * _MULT[n - 1] * np.uint64(n)
        same = doc[:len(acc)] == doc[n - 1:]
        bins = (((acc ^ (acc >> np.uint64(29))) * _MULT[1]) >> np.uint64(64 - 13)).astype(np.int64)
        out += np.bincount((doc[:len(acc)] * DIM + bins)[same], minlength=len(out)).astype(np.float32)
    return out.reshape(len(parts), DIM)


def vectors(blobs: list, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(blobs)) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _document_frequency(train: DataFrame) -> np.ndarray:
    """(1 + N) / (1 + df) in logs, over every training row."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIM + 1, dtype=np.int64)
        for batch in batches:
            blobs = batch["text"].tolist()
            for lo, hi in _batches(blobs):
                total[:DIM] += (counts(blobs[lo:hi]) > 0).sum(axis=0)
            total[DIM] += len(blobs)
        yield pd.DataFrame({"bin": np.arange(DIM + 1, dtype=np.int32), "n": total})

    rows = train.select("text").mapInPandas(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    df = np.zeros(DIM + 1)
    for r in rows.collect():
        df[r["bin"]] = r["n"]
    return (np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1).astype(np.float32)


def _kmeans(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spherical k-means, farthest-first start: (centroids, each row's centroid and cosine)."""
    mean = x.mean(axis=0)
    start = [int(np.argmax(x @ mean))]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(10):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cos = x @ c.T
    own = np.argmax(cos, axis=1)
    return c, own, cos[np.arange(len(x)), own]


def _length_class(sizes) -> np.ndarray:
    return np.log2(np.asarray(sizes, dtype=np.float64) + 1).astype(np.int64)


def _limits(classes: np.ndarray, cos: np.ndarray, reach: float, least: int = 30) -> np.ndarray:
    """The lowest cosine accepted in each length class; nan where no class so small has enough rows."""
    out = np.full(64, np.nan)
    for c in range(len(out)):
        some = cos[classes == c]
        if c >= SHORT:
            out[c] = reach * np.quantile(some, 0.01) if len(some) >= least else out[c - 1]
    return out


def fit(train: DataFrame, lang_col: str, clusters: int, per_language: int, seed: int):
    """idf, languages, centroids, their members' mean cosine, and the members' length classes
    and cosines, from (text, lang, id hash) rows."""
    idf = _document_frequency(train)
    size = train.groupBy(lang_col).agg(F.count(F.lit(1)).alias("rows"))
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.col("rows"))
    # one row per labelled language: that bounds the broadcast, and the draw needs no shuffle
    drawn = train.join(F.broadcast(size), lang_col).where(F.col("order") < share * F.lit(float(2**60)))
    place = F.row_number().over(Window.partitionBy(lang_col).orderBy("order", "text"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= per_language)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        blobs = rows["text"].tolist()
        x = np.concatenate([vectors(blobs[lo:hi], idf) for lo, hi in _batches(blobs)])
        c, own, cos = _kmeans(x, clusters)
        size = _length_class([len(b) for b in blobs])
        of = [own == j for j in range(len(c))]
        return pd.DataFrame({"lang": rows[lang_col].iloc[0], "c": [v.tobytes() for v in c.astype(np.float32)],
                             "mean": [float(cos[m].mean()) if m.any() else 1.0 for m in of],
                             "size": [size[m] for m in of], "cos": [cos[m].astype(np.float64) for m in of]})
    # centroids and at most per_language members of each language
    got = (drawn.select(F.col(lang_col), "text").groupBy(lang_col)
           .applyInPandas(one, "lang string, c binary, mean double, size array<long>, cos array<double>").collect())
    got.sort(key=lambda r: (r["lang"], bytes(r["c"])))
    centroids = np.array([np.frombuffer(r["c"], dtype=np.float32) for r in got]).reshape(-1, DIM)
    members = (np.array([v for r in got for v in r["size"]], dtype=np.int64),
               np.array([v for r in got for v in r["cos"]], dtype=np.float64))
    return idf, [r["lang"] for r in got], centroids, np.array([r["mean"] for r in got]), members


def identify(docs: DataFrame, train_where: Column, text_col: str = "text", lang_col: str = "lang",
             id_col: str = "doc_id", clusters: int = 4, per_language: int = 400, reach: float = 0.4,
             seed: int = 5) -> DataFrame:
    """``docs`` with lang_pred, score (cosine) and rejected, fitted on the labelled
    rows that meet ``train_where``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    train = (docs.where(train_where & F.col(lang_col).isNotNull() & has_letter)
             .select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"),
                     seeded_hash(seed, F.col(id_col), F.xxhash64(text_col)).alias("order")))
    idf, langs, centroids, mean, members = fit(train, "lang", clusters, per_language, seed)
    model = spark.sparkContext.broadcast((idf, langs, centroids, mean, _limits(*members, reach)))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        idf, langs, centroids, mean, limits = model.value
        for text in batches:
            pred, score, bad = [], [], []
            blobs = text.tolist()
            for lo, hi in _batches(blobs):
                cos = vectors(blobs[lo:hi], idf) @ centroids.T
                best = np.argmax(cos, axis=1)
                top = cos[np.arange(len(best)), best]
                pred += [langs[b] for b in best]
                score.append(np.clip(top, 0, 1).astype(np.float64))
                limit = limits[_length_class([len(b or b"") for b in blobs[lo:hi]])]
                bad.append(top < np.where(np.isnan(limit), 0.1 * mean[best], limit))
            yield pd.DataFrame({"lang_pred": pred, "score": np.concatenate(score) if score else [],
                                "rejected": np.concatenate(bad) if bad else []})

    out = without(docs, [c for c in ("lang_pred", "score", "rejected")
                         if c not in {text_col, lang_col, id_col}])
    if not langs:
        return out.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    got = free_name(out, "_got")
    out = out.withColumn(got, predict(F.col(text_col).cast("binary")))
    und = ~has_letter
    return out.withColumns({
        "lang_pred": F.when(und, F.lit("und")).otherwise(F.col(f"{got}.lang_pred")),
        "score": F.when(und, F.lit(0.0)).otherwise(F.col(f"{got}.score")),
        "rejected": und | F.col(f"{got}.rejected")}).drop(got)

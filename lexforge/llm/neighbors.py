"""Approximate nearest neighbours by cross-polytope hashing, exact reranking.

Largest inner product becomes smallest angle: vectors are scaled by the
largest norm and get one more coordinate that makes them unit vectors, queries
get a zero there.  A table rotates them pseudo-randomly (three rounds of random
signs and a fast Hadamard transform) and assigns each vector to the signed
axis nearest to it.  A query probes its nearest signed axes in each table, as many
as a sample of queries needs: for at most ``sample`` of them the true neighbours
are found in one pass over all vectors, and the probes are the fewest with which
``recall`` of these neighbours lie in a probed cell.  The more vectors there
are, the nearer are the k nearest, and the fewer probes it takes.  What lies there is scored exactly, in double precision, on the original
vectors.  Cells are cut into blocks of about ``block`` vectors and queries, so
a cell that holds a third of all rows is many small block pairs.  Tasks keep
the best k of each query over all their blocks before anything is shuffled.
A query that finds fewer than k probes every cell of the first table.

Defined results: vectors that are null, all zero, of another length than the
most frequent one, or hold a null or non-finite component take no part; equal
scores are ordered by id; an empty table gives an empty result; rows with the
same id as the query are not its neighbours; rows that repeat an id are one
candidate, with the largest of their products, and one query each with the same
name, whose neighbours are found together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import written


def _rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` after rounds of random signs and a Hadamard transform."""
    for s in signs:
        x = x * s
        h, n = 1, x.shape[1]
        while h < n:
            v = x.reshape(len(x), -1, 2, h)
            x = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), axis=2).reshape(len(x), n)
            h *= 2
    return x


def _signs(tables: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, dim))


def _cells_udf(tables: int, probes: int, dim: int, top: float, seed: int, query: bool = False):
    """Signed axes (table * 2 dim + axis) of a vector: one a table, or ``probes`` for a query."""
    signs = _signs(tables, dim, seed)

    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vec in batches:
            if not len(vec):
                yield pd.Series([], dtype=object)
                continue
            raw = np.vstack(vec.to_numpy()).astype(np.float64)
            x = np.zeros((len(raw), dim))
            norm = np.linalg.norm(raw, axis=1)
            x[:, :raw.shape[1]] = raw / (norm[:, None] if query else top)
            if not query:
                x[:, raw.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))
            out = []
            for t in range(tables):
                y = _rotated(x, signs[t])
                # both signs of an axis: the far one comes last
                near = np.stack((-y, y), axis=2).reshape(len(y), 2 * dim)
                out.append(t * 2 * dim + np.argsort(-near, axis=1, kind="stable")[:, :probes])
            yield pd.Series(list(np.concatenate(out, axis=1).astype(np.int32)))
    return cells


def _distinct(pairs, k: int) -> list[tuple]:
    """The first k of sorted (key, id) pairs, one an id."""
    seen, out = set(), []
    for pair in pairs:
        if pair[1] not in seen:
            seen.add(pair[1])
            out.append(pair)
            if len(out) == k:
                break
    return out


def _best(k: int):
    """Sorted block rows to the k best (query, id, score) seen by this task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        key, items, asked = None, [], []

        def close():
            if items and asked:
                items.sort(key=lambda r: r[0])                  # ties go to the smaller id
                ids = np.array([r[0] for r in items])
                x = np.vstack([r[1] for r in items]).astype(np.float64)
                q = np.vstack([r[1] for r in asked]).astype(np.float64)
                # a plain loop over the components: equal vectors get equal scores
                score = np.einsum("ik,jk->ij", q, x, optimize=False)
                order = np.argsort(-score, axis=1, kind="stable")
                for i, (query, _) in enumerate(asked):
                    new = _distinct(((-score[i, j], ids[j]) for j in order[i] if ids[j] != query), k)
                    have = best.get(query)
                    best[query] = new if have is None else _distinct(sorted({*have, *new}), k)

        def flush():
            rows = [(query, i, -s) for query, found in best.items() for s, i in found]
            best.clear()
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        for batch in batches:
            for cell, is_query, vid, vec in zip(batch["cell"], batch["is_query"], batch["id"], batch["vec"]):
                if cell != key:
                    close()
                    key, items, asked = cell, [], []
                    if len(best) > 50_000:
                        yield flush()
                (asked if is_query else items).append((vid, vec))
        close()
        yield flush()
    return run


def _block_pairs(items: DataFrame, asked: DataFrame, block: int) -> DataFrame:
    """Rows (cell, is_query, id, vec): every item block of a cell with every query block."""
    sides = []
    count = {n: d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(n))
             for n, d in (("ib", items), ("qb", asked))}
    sizes = count["ib"].join(count["qb"], "cell")
    for is_query, rows in ((False, items), (True, asked)):
        own, other = ("qb", "ib") if is_query else ("ib", "qb")
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        rows = rows.join(sizes, "cell").withColumn("own", mine).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, q = ("other", "own") if is_query else ("own", "other")
        sides.append(rows.select(F.concat_ws("/", "cell", i, q).alias("cell"),
                                 F.lit(is_query).alias("is_query"), "id", "vec"))
    return sides[0].union(sides[1])


def _search(items: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    kind = items.schema["id"].dataType.simpleString()
    pairs = _block_pairs(items, asked, block).repartition("cell").sortWithinPartitions("cell", "is_query")
    found = pairs.mapInPandas(_best(k), f"query_id {kind}, vec_id {kind}, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _axis_order(q: np.ndarray, signs: np.ndarray, dim: int) -> np.ndarray:
    """Probe rank of every signed axis for a query: (tables, 2 dim)."""
    x = np.zeros((1, dim))
    x[0, :len(q)] = q
    rank = np.empty((len(signs), 2 * dim), dtype=np.int64)
    for t, s in enumerate(signs):
        y = _rotated(x, s)[0]
        near = np.empty(2 * dim)
        near[0::2], near[1::2] = -y, y                       # axis 2 i + 1 is the positive one
        rank[t, np.argsort(-near, kind="stable")] = np.arange(2 * dim)
    return rank


def probes_needed(items: DataFrame, asked: DataFrame, k: int, tables: int, dim: int, recall: float,
                  sample: int, seed: int) -> tuple[int, float]:
    """(probes, share of the sample's true neighbours they reach); items have id, vec and one cell a table."""
    drawn = asked.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).collect()      # at most ``sample``
    if not drawn:
        return 1, 1.0
    ids = [r["id"] for r in drawn]
    q = np.vstack([r["vec"] for r in drawn]).astype(np.float64)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [[] for _ in ids]
        for batch in batches:
            if not len(batch):
                continue
            own, cells = batch["id"].to_numpy(), batch["cells"].to_numpy()
            score = np.vstack(batch["vec"].to_numpy()).astype(np.float64) @ q.T
            for i, query in enumerate(ids):
                near = [j for j in np.argsort(-score[:, i], kind="stable")[:k + 1] if own[j] != query]
                kept[i] = sorted(kept[i] + [(-score[j, i], own[j], cells[j]) for j in near], key=lambda r: r[:2])[:k]
        rows = [(i, -s, c) for i, found in enumerate(kept) for s, _, c in found]
        yield pd.DataFrame(rows, columns=["query", "score", "cells"])

    found = items.select("id", "vec", "cells").mapInPandas(best, "query int, score double, cells array<int>")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    found = found.withColumn("place", place).where(F.col("place") <= k).collect()           # sample * k rows
    signs = _signs(tables, dim, seed)
    order = [_axis_order(v, signs, dim) for v in q]
    first = np.sort([min(int(order[r["query"]][t, c - t * 2 * dim]) for t, c in enumerate(r["cells"])) for r in found])
    if not len(first):
        return 1, 1.0
    need = int(first[min(len(first) - 1, int(np.ceil(recall * len(first))) - 1)]) + 1
    return need, float((first < need).mean())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 12, probes: int | None = None,
            block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 3,
            recall: float = 0.98, sample: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found of each query.

    ``probes`` (None: as many as the sample needs) signed axes are visited in each table.
    """
    def valid(df):
        return (df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
                .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
                .where(F.coalesce(F.forall("vec", lambda x: x.isNotNull()), F.lit(False)))
                .where(F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
                .where(F.exists("vec", lambda x: x != 0)))

    items, asked = valid(vectors), valid(queries)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    shape = items.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.max(norm).alias("top"))
    shape = shape.orderBy(F.desc("c"), "n").limit(1).collect()
    n, top = (shape[0]["n"], shape[0]["top"]) if shape else (1, 1.0)
    items, asked = items.where(F.size("vec") == n), asked.where(F.size("vec") == n)
    dim = 1 << int(n).bit_length()                         # a power of two above n
    placed = written(items.withColumn("cells", _cells_udf(tables, 1, dim, top, seed)("vec")))
    if probes is None:
        probes, _ = probes_needed(placed, asked, k, tables, dim, recall, sample, seed)
    spread = placed.select("id", "vec", F.explode("cells").alias("cell"))
    probed = (written(asked.withColumn("cells", _cells_udf(tables, probes, dim, top, seed, True)("vec")))
              .select("id", "vec", F.explode("cells").alias("cell")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found):
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = written(ranked(_search(spread, probed, k, block)))
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = asked.join(enough, "id", "left_anti")
    if not short.isEmpty():
        every = short.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(2 * dim - 1))))
        more = _search(spread.where(F.col("cell") < 2 * dim), every, k, block)
        found = found.drop("rank").unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = ranked(found)
    return found.select("query_id", "rank", "vec_id", "score")

"""Hard-negative mining with cover trees over norm-augmented candidates.

A candidate c gets one more coordinate, sqrt(M**2 - |c|**2), M the largest
norm, and an anchor q gets a zero there.  Then |q - c|**2 = |q|**2 + M**2 - 2 q.c:
the distance d from q to a node's centre and the node's covering radius r bound
the inner products of everything below it by
(|q|**2 + M**2 - (d -+ r)**2) / 2.

* The top level is a net of rows of a bounded, seeded sample: one centre for
  each ``block_rows`` rows, at most ``centers``.  Each row goes to its nearest
  centre.  Rows of one centre form a cell, cut into blocks of about
  ``block_rows`` rows, so a cell that holds a third of all rows is many blocks.
* Each block is one cover tree, built in its own task: the centres of a level
  are more than half the node's radius apart and cover it to half the radius.
* A search asks for the k largest inner products inside a window [low, high]
  with rows of the same label, or of other labels.  It goes best-first: nodes
  outside the window, or below the k-th best found, are skipped, and what is
  left in a leaf is verified in exact integers.  A first round visits the
  cells nearest to the window's upper end; the k-th best found there is the
  floor of the second, which visits all other cells that may hold better ones.
* The positives are one search (same label, no window); each positive gives
  the window of a second one for its negatives.

Nothing is approximate: bounds only decide what need not be looked at.

Defined results: rows with a null label, a null vector or a null component take
no part; of vectors of different lengths the shorter ones end in zeros; equal
scores are ordered by id, null last, then by row; each of several equal rows
is a row of its own, also as an anchor; an empty table gives an empty result.
Products of norms have to stay below 2**62.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import small_batches, written

_HITS = "anchor long, turn int, score long, id long, row long"
_MODEST = 2.0 ** 50      # inner products below this are exact in doubles, and faster there


def _matrix(vecs, dim: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    if len(vecs) and all(len(v) == dim for v in vecs):
        return np.vstack(vecs).astype(np.int64).reshape(len(vecs), dim)
    out = np.zeros((len(vecs), dim), dtype=np.int64)
    for i, v in enumerate(vecs):
        out[i, :len(v)] = v
    return out


def _augmented(v: np.ndarray, square: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.hstack((x, np.sqrt(np.maximum(square - (x * x).sum(axis=1, keepdims=True), 0))))


def _far(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(axis=1))


def _net(x: np.ndarray, first: int, within: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centres until all rows are ``within`` one: (centres, nearest, distance)."""
    chosen, near = [first], np.zeros(len(x), dtype=np.int64)
    dist = _far(x, x[first])
    while len(chosen) < most and (far := int(np.argmax(dist))) >= 0 and dist[far] > within:
        d = _far(x, x[far])
        closer = d < dist
        near[closer], dist[closer] = len(chosen), d[closer]
        chosen.append(far)
    return chosen, near, dist


class CoverTree:
    """Nodes as arrays; the rows of a node are consecutive in ``order``.

    A node's children have their centres more than half its radius apart, and
    all its rows within half its radius of one; its own centre is one of them.
    A node that this would only split into single rows stays a leaf.
    """

    FIELDS = ("order", "center", "radius", "lo", "hi", "child", "n_child", "reach")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = 24) -> CoverTree:
        order = np.arange(len(x))
        reach = np.zeros(len(x))                      # distance to the centre of the row's leaf
        center, radius, lo, hi, child, n_child = [], [], [], [], [], []

        def node(c: int, a: int, b: int) -> None:
            center.append(c)
            d = _far(x[order[a:b]], x[c])
            reach[a:b] = d
            radius.append(d.max())
            lo.append(a), hi.append(b), child.append(0), n_child.append(0)

        node(int(np.argmin(_far(x, x.mean(axis=0)))), 0, len(x))
        i = 0
        while i < len(center):
            a, b, r = lo[i], hi[i], radius[i]
            if b - a > leaf and r > 0:
                rows = order[a:b].copy()
                at = int(np.flatnonzero(rows == center[i])[0])
                chosen, near, _ = _net(x[rows], at, r / 2, (b - a) // 2 + 1)
                if len(chosen) <= (b - a) // 2:
                    order[a:b] = rows[np.argsort(near, kind="stable")]
                    child[i], n_child[i] = len(center), len(chosen)
                    ends = a + np.concatenate(([0], np.cumsum(np.bincount(near, minlength=len(chosen)))))
                    for j, c in enumerate(chosen):
                        node(int(rows[c]), int(ends[j]), int(ends[j + 1]))
            i += 1
        return cls(order=order, center=np.array(center), radius=np.array(radius), lo=np.array(lo), hi=np.array(hi),
                   child=np.array(child), n_child=np.array(n_child), reach=reach)

    def dump(self) -> dict[str, np.ndarray]:
        return {f: getattr(self, f) for f in self.FIELDS}


def _bounds(qq: float, ip: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product within ``radius`` of points with product ``ip``; qq = |q|**2 + M**2."""
    d = np.sqrt(np.maximum(qq - 2.0 * ip, 0))
    room = 1 + 1e-11 * qq
    return (qq - (d + radius) ** 2) / 2 - room, (qq - np.maximum(d - radius, 0) ** 2) / 2 + room


class _Block:
    """One block's rows and tree, read from the index."""

    def __init__(self, blob: bytes, square: float):
        with np.load(io.BytesIO(blob)) as a:
            self.tree = CoverTree(**{f: a[f] for f in CoverTree.FIELDS})
            self.v, self.id, self.row, self.label, self.no_id = a["v"], a["id"], a["row"], a["label"], a["no_id"]
        self.exact = self.v.astype(np.int64 if square >= _MODEST else np.float64)
        self.square = square

    def search(self, q: np.ndarray, own: int, label: int, same: bool, low: float, high: float,
               k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k best rows with low <= product <= high, best first, and their products."""
        t = self.tree
        q = q.astype(self.exact.dtype)
        qq = float((q.astype(np.float64) ** 2).sum()) + self.square
        _, most = _bounds(qq, np.array([float(self.exact[t.center[0]] @ q)]), t.radius[:1])
        todo = [(-min(most[0], high), 0, float(self.exact[t.center[0]] @ q))]
        best_at, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        while todo:
            bound, i, ip = heapq.heappop(todo)
            if -bound < low:
                break
            if t.n_child[i]:
                j = np.arange(t.child[i], t.child[i] + t.n_child[i])
                ips = (self.exact[t.center[j]] @ q).astype(np.float64)
                least, most = _bounds(qq, ips, t.radius[j])
                for e in np.flatnonzero((most >= low) & (least <= high)).tolist():
                    heapq.heappush(todo, (-min(most[e], high), int(j[e]), float(ips[e])))
                continue
            lo, hi = t.lo[i], t.hi[i]
            d = math.sqrt(max(qq - 2 * ip, 0))
            near = (qq - (d - t.reach[lo:hi]) ** 2) / 2 + 1 + 1e-11 * qq      # most that each row can have
            far = (qq - (d + t.reach[lo:hi]) ** 2) / 2 - 1 - 1e-11 * qq
            at = t.order[lo:hi][(near >= low) & (far <= high)]
            at = at[((self.label[at] == label) == same) & (self.row[at] != own)]
            score = (self.exact[at] @ q).astype(np.int64)
            fits = (score >= low) & (score <= high)
            best_at, best = np.concatenate((best_at, at[fits])), np.concatenate((best, score[fits]))
            if len(best) >= k:
                first = np.lexsort((self.row[best_at], self.id[best_at], self.no_id[best_at], -best))[:k]
                best_at, best = best_at[first], best[first]
                low = max(low, int(best[-1]))
        first = np.lexsort((self.row[best_at], self.id[best_at], self.no_id[best_at], -best))[:k]
        return best_at[first], best[first]


class HardNegativeIndex:
    """Cover trees over all rows of (row, id, label, v), written in blocks to the shared folder."""

    def __init__(self, rows: DataFrame, centers: int = 256, sample: int = 4096, block_rows: int = 2048, seed: int = 11):
        self.spark = rows.sparkSession
        size = rows.select(F.max(F.size("v")).alias("dim"), F.max(_square("v")).alias("square"),
                           F.count(F.lit(1)).alias("n")).first()
        self.dim, self.square = size["dim"] or 0, float(size["square"] or 0)
        # a bounded sample places the centres; every row is indexed
        drawn = rows.select("v").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sample).toPandas()["v"]
        x = _augmented(_matrix(list(drawn), self.dim), self.square)
        chosen = _net(x, 0, 0.0, min(centers, math.ceil(size["n"] / block_rows)))[0] if len(x) else []
        self.net = x[chosen]
        self.centers = self.spark.sparkContext.broadcast((self.net, self.dim, self.square))
        with small_batches(self.spark):
            placed = written(rows.withColumn("at", _nearest(self.centers)("v")).select("*", "at.cell", "at.dist").drop("at"))
        cells = (placed.groupBy("cell").agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()
                 .sort_values("cell", ignore_index=True))        # at most ``centers`` rows
        cells["blocks"] = np.ceil(cells["n"] / block_rows).astype(np.int64)
        self.cells = cells
        self.keys = self.spark.createDataFrame(
            [(int(c.cell), int(c.blocks)) for c in cells.itertuples()], "cell int, blocks long")
        self.index = written(_built(placed, self.keys, self.dim, self.square))

    def search(self, queries: DataFrame, k: int, seeds: int = 2, slice_rows: int = 1024) -> DataFrame:
        """(anchor, turn, rank, score, id, row): the k best rows of each query.

        ``queries``: anchor (its row), turn, v, label, same, low and high (null: open).
        """
        queries = queries.withColumn("floor", F.lit(None).cast("long"))
        first = written(_ranked(self._visited(queries, k, seeds, True, slice_rows), k))
        floors = (first.where(F.col("rank") == k).select("anchor", "turn", F.col("score").alias("floor")))
        second = self._visited(queries.drop("floor").join(floors, ["anchor", "turn"], "left"), k, seeds, False, slice_rows)
        return written(_ranked(first.drop("rank").unionByName(second), k))

    def _visited(self, queries: DataFrame, k: int, seeds: int, first: bool, slice_rows: int) -> DataFrame:
        route = _route(self.centers, self.spark.sparkContext.broadcast(self.cells), seeds, first)
        slices = max(1, math.ceil(queries.count() / slice_rows))
        asked = (queries.withColumn("cell", F.explode(route("v", "low", "high", "floor")))
                 .join(F.broadcast(self.keys), "cell")      # ``centers`` rows at most
                 .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                 .withColumn("slice", F.pmod(F.xxhash64("anchor", "turn"), F.lit(slices))))
        asked = (asked.groupBy("cell", "block", "slice")
                 .agg(F.collect_list(F.struct("anchor", "turn", "v", "label", "same", "low", "high", "floor")).alias("asked")))
        square, dim = self.square, self.dim

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for blob, queries in zip(batch["blob"], batch["asked"]):
                    block, out = _Block(blob, square), []
                    for q, v in zip(queries, _matrix([q["v"] for q in queries], dim)):
                        low = max([x for x in (q["low"], q["floor"]) if x is not None], default=-math.inf)
                        high = math.inf if q["high"] is None else q["high"]
                        at, score = block.search(v, q["anchor"], q["label"], q["same"], low, high, k)
                        out += [(q["anchor"], q["turn"], s, None if block.no_id[a] else block.id[a], block.row[a])
                                for a, s in zip(at.tolist(), score.tolist())]
                    made = pd.DataFrame(out, columns=["anchor", "turn", "score", "id", "row"])
                    yield made.astype({"id": "Int64"})
        with_block = asked.join(self.index, ["cell", "block"]).select("blob", "asked")
        with small_batches(self.spark):
            return written(with_block.mapInPandas(answer, _HITS))


def _square(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _nearest(centers):
    @F.pandas_udf("cell int, dist double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, dim, square = centers.value
        for v in batches:
            x = _augmented(_matrix(list(v), dim), square)
            d = (x * x).sum(axis=1, keepdims=True) + (net * net).sum(axis=1) - 2 * x @ net.T
            cell = np.argmin(d, axis=1).astype(np.int32)
            yield pd.DataFrame({"cell": cell, "dist": np.sqrt(((x - net[cell]) ** 2).sum(axis=1))})
    return nearest


def _built(placed: DataFrame, keys: DataFrame, dim: int, square: float) -> DataFrame:
    """(cell, block, blob), a cover tree with its rows for each block."""
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(list(rows["v"]), dim)
        tree = CoverTree.build(_augmented(v, square))
        small = np.int32 if len(v) == 0 or np.abs(v).max(initial=0) < 2**31 else np.int64
        buf = io.BytesIO()
        np.savez(buf, v=v.astype(small), row=rows["row"].to_numpy(np.int64), label=rows["label"].to_numpy(np.int64),
                 id=rows["id"].fillna(0).to_numpy(np.int64), no_id=rows["id"].isna().to_numpy(), **tree.dump())
        return pd.DataFrame({"cell": [key[0]], "block": [key[1]], "blob": [buf.getvalue()]})
    spread = (placed.join(F.broadcast(keys), "cell")
              .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))))
    return (spread.select("cell", "block", "row", "id", "label", "v").groupBy("cell", "block")
            .applyInPandas(one, "cell int, block long, blob binary"))


def _route(centers, cells, seeds: int, first: bool):
    """Cells to visit: the ``seeds`` nearest to the window's upper end, or all others that may hold better rows."""
    @F.pandas_udf("array<int>")
    def route(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        net, dim, square = centers.value
        at, radius = cells.value["cell"].to_numpy(), cells.value["radius"].to_numpy() * (1 + 1e-11)
        for v, low, high, floor in batches:
            out = []
            for q, lo, hi, fl in zip(_matrix(list(v), dim).astype(np.float64), low, high, floor):
                ip = net[at, :-1] @ q
                least, most = _bounds(float((q * q).sum()) + square, ip, radius)
                lo, hi = (-math.inf if pd.isna(lo) else lo), (math.inf if pd.isna(hi) else hi)
                by = np.argsort(-ip if hi == math.inf else np.abs(ip - hi), kind="stable")
                by = by[(most[by] >= lo) & (least[by] <= hi)]
                rest = by[seeds:]
                if not pd.isna(fl):
                    rest = rest[most[rest] >= fl]
                out.append(at[by[:seeds] if first else rest].astype(np.int32))
            yield pd.Series(out, dtype=object)
    return route


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "turn").orderBy(
        F.desc("score"), F.asc_nulls_last("id"), "row"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label",
                        vec_col: str = "embedding", positives: int = 5, negatives: int = 10,
                        low_percent: int = 30, high_percent: int = 90, **index) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    ``vec_col`` holds integers; ``anchors`` says which rows are anchors.  The
    positives of an anchor are its best other rows of the same label; for
    each, the best rows of other labels with
    low_percent * positive <= 100 * negative <= high_percent * positive.
    """
    vec = F.col(vec_col)
    rows = vectors.where(F.col(label_col).isNotNull() & vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull()))
    # the row number is fixed by being written
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                               F.col(label_col).cast("long").alias("label"),
                               vec.cast("array<bigint>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks")))
    trees = HardNegativeIndex(rows.drop("asks"), **index)
    asks = rows.where("asks").select(F.col("row").alias("anchor"), "id", "label", "v")
    none = F.lit(None).cast("long")
    first = trees.search(asks.select("anchor", F.lit(0).alias("turn"), "v", "label", F.lit(True).alias("same"),
                                     none.alias("low"), none.alias("high")), positives)
    first = first.select("anchor", F.col("rank").alias("turn"), F.col("id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
    pos = F.col("positive_score")
    windows = (first.where(pos >= 0).join(asks, "anchor").select(
        "anchor", "turn", "v", "label", F.lit(False).alias("same"),
        F.call_function("div", pos * low_percent + 99, F.lit(100)).alias("low"),
        F.call_function("div", pos * high_percent, F.lit(100)).alias("high")).where("low <= high"))
    second = trees.search(windows, negatives)
    return (second.join(first, ["anchor", "turn"]).join(asks.select("anchor", F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("turn").alias("positive_rank"), "rank",
                    F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))

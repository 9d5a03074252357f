"""N-gram Jaccard join: rare-first prefix filtering, each pair verified once.

1. Every document becomes its set of distinct k-word shingles (64-bit hashes).
   Equal sets form one *node*, named by a 64-bit hash of the set, so exact
   copies never meet as pairs.
2. Shingle frequencies of all documents are counted in 2**17 hashed counters (a
   fixed bound for the broadcast).  Ordering a set by (counter, hash) puts
   rare shingles first; any fixed order is exact, a rarer start only gives
   fewer candidates.
3. Two sets that reach the threshold share a shingle within the first
   n - ceil(t n) + 1 of that order.  Those prefix shingles are joined, and the
   length and positional filters apply inside the join, and so does a suffix
   filter: the counts of both sets in 64 hash classes bound from below how many
   shingles they do not share.
4. Surviving pairs fetch the two texts, from a table bucketed by node, and are
   verified exactly, once.  Only texts of nodes that share a prefix shingle with
   another node get there: tasks look them up in a bit map of fixed size.

Groups of thousands of near copies would yield all their pairs.  Components
need only enough links, so two rounds first link each node to leaders of
the prefix shingles it shares.  After that all pairs of *different* components are
taken, for each shingle between the members outside its largest component and
all its members: no link between components is lost, whatever the leaders were.

Defined results: a null or wordless text has no shingles, links with nothing
and is its own class; fewer than k words are one shingle; ids need not be
unique (a row is known by id and text); classes are named by the smallest id;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import (discard, free_name, hash_bitmap, in_bitmap, small_batches, written,
                                 written_buckets)
from lexforge.llm.components import components
from lexforge.llm.tokens import SPACE, chunks, distinct_grams, salted

COUNTER_BITS = 17
CLASSES = 64
NODE_BITS = 24         # of the bit map of nodes that may have links: 2 MB
SLICE = 1 << 20        # bytes of text tokenised at once
_NO_LINKS = "x long, y long, ok boolean"


def _running(values: np.ndarray) -> np.ndarray:
    """0 and the running sums modulo 2**64; a plain 0 in front would make them floats, whose
    rounding names equal sets by their place in a batch."""
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))


def _nodes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The names of sets: sums of salted shingle hashes."""
    total = _running(salted(h, 0))
    return total[off[1:]] - total[off[:-1]]


def _set_udf(k: int, percent: int, freq):
    """A text's set: its size, node, class counts and rare-first prefix."""
    @F.pandas_udf("n long, node long, classes array<tinyint>, prefix array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            n_all, node_all, class_all, prefix_all = [], [], [], []
            for lo, hi, t in chunks(text.tolist(), SPACE, True, SLICE):
                h, off = distinct_grams(t, k)
                doc = np.repeat(np.arange(hi - lo), np.diff(off))
                n_all.append(np.diff(off))
                node_all.append(_nodes(h, off).view(np.int64))
                cls = np.bincount(doc * CLASSES + (h & np.uint64(CLASSES - 1)).astype(np.int64),
                                  minlength=(hi - lo) * CLASSES)
                # counts stop at 127: differences only get smaller, the filter stays safe
                class_all.extend(np.minimum(cls, 127).astype(np.int8).reshape(-1, CLASSES))
                rare = freq.value[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                # one key for (frequency, hash); shingles equal in it stay in hash order
                key = (np.minimum(rare, 2**24 - 1).astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    size = b - a + (-percent * (b - a)) // 100 + 1 if b > a else 0      # n - ceil(t n) + 1
                    prefix_all.append(h[a:b][np.argsort(key[a:b], kind="stable")[:size]].view(np.int64))
            yield pd.DataFrame({"n": np.concatenate(n_all) if n_all else [],
                                "node": np.concatenate(node_all) if node_all else [], "classes": class_all,
                                "prefix": prefix_all})
    return sets


def _linked_node_udf(k: int, linked):
    """A text's node if the bit map has it, else null."""
    @F.pandas_udf("long")
    def node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            out = [np.empty(0, dtype=np.uint64)]
            for _, _, t in chunks(text.tolist(), SPACE, True, SLICE):
                out.append(_nodes(*distinct_grams(t, k)))
            h = np.concatenate(out)
            yield pd.Series(h.view(np.int64)).astype("Int64").where(in_bitmap(linked.value, h))
    # not deterministic for the optimiser, which would run it once more in the filter
    return node.asNondeterministic()


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Documents per shingle counter, over all documents."""
    size = 1 << COUNTER_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, _, t in chunks(batch["text"].tolist(), SPACE, True, SLICE):
                h, _ = distinct_grams(t, k)
                total += np.bincount((h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=size)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"counter": some.astype(np.int32), "n": total[some]})

    rows = (docs.select("text").mapInPandas(count, "counter int, n long")
            .groupBy("counter").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(size, dtype=np.int64)
    out[rows["counter"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def _overlap_needed(nx: Column, ny: Column, percent: int) -> Column:
    """Smallest intersection with 100 * i >= percent * (nx + ny - i)."""
    return F.ceil((nx + ny).cast("long") * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9)).cast("long")


def _may_link(percent: int, x: str = "l", y: str = "r") -> Column:
    """Length and positional filter on two prefix rows of one token."""
    nx, ny, px, py = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    length = F.least(nx, ny).cast("long") * 100 >= F.greatest(nx, ny).cast("long") * percent
    return length & (F.least(nx - px, ny - py) >= _overlap_needed(nx, ny, percent))


def _close(percent: int, x: str, y: str) -> Column:
    """Suffix filter: the class counts of two sets differ by no more than a link allows."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = F.aggregate(F.zip_with(f"{x}.classes", f"{y}.classes", lambda a, b: F.abs(a.cast("int") - b)),
                        F.lit(0), lambda s, d: s + d)
    return apart <= nx + ny - 2 * _overlap_needed(nx, ny, percent)


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(x, y, ok) for distinct pairs (x, y) of nodes, by an exact count."""
    for s in "xy":
        pairs = pairs.join(texts.select(F.col("node").alias(s), F.col("text").alias(f"t{s}")), s)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t for two in zip(batch["tx"], batch["ty"]) for t in two]
            ok, half = [], []
            for _, _, t in chunks(texts, SPACE, True, SLICE):
                h, off = distinct_grams(t, k)
                for i in range(t.n_texts):
                    half.append(h[off[i]:off[i + 1]].copy())
                    if len(half) == 2:
                        both = len(np.intersect1d(*half, assume_unique=True))
                        ok.append(100 * both >= percent * (len(half[0]) + len(half[1]) - both))
                        half = []
            yield pd.DataFrame({"x": batch["x"], "y": batch["y"], "ok": ok})
    return pairs.select("x", "y", "tx", "ty").mapInPandas(check, _NO_LINKS)


def _open_rows(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Prefix rows with their node's component so far; tokens of one component are done."""
    found = components(links.where("ok").select(F.col("x").alias("u"), F.col("y").alias("v")))
    rows = (rows.drop("comp").join(found, "node", "left")
            .withColumn("comp", F.coalesce("component", "node")).drop("component"))
    return written(_shared(rows, "comp"))


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """Rows of tokens with more than one value of ``by``; one exchange, by token."""
    of_token = Window.partitionBy("token")
    return (rows.withColumns({"_least": F.min(by).over(of_token), "_most": F.max(by).over(of_token)})
            .where("_least != _most").drop("_least", "_most"))


def _leader_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of nodes with drawn leaders of their tokens, more leaders in each turn.

    A node keeps those leaders with which it shares most tokens.  This only
    saves work: pairs left out here are met in :func:`_cross_pairs`.
    """
    draw = F.row_number().over(Window.partitionBy("token").orderBy(
        F.xxhash64(F.lit(turn), "token", "node"), "node"))
    leader = rows.withColumn("draw", draw).where(F.col("draw") <= 4 ** turn)
    l, r = rows.alias("l"), leader.alias("r")
    met = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.comp") != F.col("r.comp"))
                 & _may_link(percent))
    met = met.groupBy(F.col("l.node").alias("x"), F.col("r.node").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("c"), "y"))
    met = met.withColumn("place", best).where(F.col("place") <= 4 * (3 * turn + 1))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _cross_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different components that pass the filters of a shared token."""
    per = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top")).select("token", F.col("top.comp").alias("top"))
    rows = rows.join(nodes.select("node", "classes"), "node").join(top, "token")
    l, r = rows.where("comp != top").alias("l"), rows.alias("r")
    met = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.comp") != F.col("r.comp"))
                 & ((F.col("r.comp") == F.col("r.top")) | (F.col("l.node") < F.col("r.node")))
                 & _may_link(percent) & _close(percent, "l", "r"))
    return met.select(F.least("l.node", "r.node").alias("x"), F.greatest("l.node", "r.node").alias("y")).distinct()


def _close_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the suffix filter."""
    l, r = nodes.alias("l"), nodes.alias("r")
    return (pairs.join(l, F.col("x") == F.col("l.node")).join(r, F.col("y") == F.col("r.node"))
            .where(_close(percent, "l", "r")).select("x", "y"))


def _classes(docs: DataFrame, k: int, percent: int, leader_rounds: int) -> DataFrame:
    """The columns of ``docs`` but text, with n and comp, the node that names the row's class
    (null without shingles); all Python work is written before it returns."""
    spark = docs.sparkSession
    carried = [c for c in docs.columns if c != "text"]
    freq = spark.sparkContext.broadcast(_frequencies(docs, k))
    sets = written(docs.select(*carried, _set_udf(k, percent, freq)("text").alias("s")).select(*carried, "s.*"))
    # copies are folded by task, before their prefixes are taken apart
    once = sets.where("n > 0").dropDuplicates(["node"])
    rows = written(_shared(once.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")),
                           "node"))
    nodes = sets.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("classes").alias("classes"))
    nodes = written(nodes.join(rows.select("node").distinct(), "node"))
    linked = spark.sparkContext.broadcast(hash_bitmap(nodes.select(F.col("node").alias("h")), NODE_BITS))
    # texts of one node have equal sets, so any of them will do
    texts = (docs.select(_linked_node_udf(k, linked)("text").alias("node"), "text").where("node is not null")
             .dropDuplicates(["node"]).join(nodes, "node", "left_semi"))

    first, rows, links = rows, rows.withColumn("comp", F.col("node")), None
    with written_buckets(texts, "node") as texts:
        for turn in range(leader_rounds + 1):
            if links is not None:
                before, rows = rows, _open_rows(rows, links)
                discard(first, before)
            if turn < leader_rounds:
                pairs = _close_pairs(_leader_pairs(rows, percent, turn), nodes, percent)
            else:
                pairs = _cross_pairs(rows, nodes, percent)
            if links is not None:      # each pair is verified once
                pairs = pairs.join(links, ["x", "y"], "left_anti")
            new = written(_verify(pairs, texts, k, percent))
            links = new if links is None else links.unionByName(new)

    found = written(components(links.where("ok").select(F.col("x").alias("u"), F.col("y").alias("v"))))
    discard(rows, nodes)
    return (sets.join(found, "node", "left")
            .withColumn("comp", F.when(F.col("n") > 0, F.coalesce("component", "node")))
            .select(*carried, "n", "comp"))


def _named(out: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id) from the rows of :func:`_classes`."""
    # a table of its own, so that the join is a plain one whose hot classes can be split
    least = written(out.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least")))
    return (out.join(least, "comp", "left")
            .select("id", F.col("n").alias("n_shingles"),
                    F.coalesce("least", "id").alias("component_id")))


def jaccard_classes(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id",
                    text_col: str = "text", leader_rounds: int = 2) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id reachable by
    links of sets with 100 * intersection >= ``percent`` * union.
    """
    with small_batches(docs.sparkSession, "2m"):
        found = _named(_classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")),
                                k, percent, leader_rounds))
    return found.withColumnRenamed("id", id_col)


def _value_hash(docs: DataFrame) -> Column:
    """A hash of all values of a row; the null flags keep a value from moving to another column."""
    cols = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in docs.dtypes]
    return F.xxhash64(*cols, *[F.col(c).isNull() for c in docs.columns])


def _with_address(docs: DataFrame, file: str, place: str) -> DataFrame:
    """``docs`` with the file and the place in it of each row; rows that do not lie in Parquet files are written first."""
    def address(df):
        return df.withColumns({file: F.xxhash64("_metadata.file_path"), place: F.col("_metadata.row_index")})
    try:
        return address(docs)
    except AnalysisException:
        return address(written(docs))


def one_per_class(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the smallest id, null last, then the smallest hash
    of all values; of equal rows any one, rows without shingles all.
    """
    names = docs.columns
    file, place = free_name(docs, "_file"), free_name(docs, "_place")
    docs = _with_address(docs, file, place)
    with small_batches(docs.sparkSession, "2m"):
        out = _classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                                   _value_hash(docs.select(*names)).alias("hash"), F.col(file).alias("file"),
                                   F.col(place).alias("place")), k, percent, 2)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "hash", "file", "place")
    out = written(out.where("comp is not null").select("comp", order.alias("at")))
    first = out.groupBy("comp").agg(F.min("at").alias("first"))
    # what goes is far less than what stays
    gone = written(out.join(first, "comp").where("at != first")
                   .select(F.col("at.file").alias(file), F.col("at.place").alias(place)))
    return docs.join(gone, [file, place], "left_anti").select(*names)

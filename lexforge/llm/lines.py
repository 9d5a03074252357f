"""Line dedup by site-relative frequency, DataFrame operations only.

For each host the pages that contain a line (compared without outer spaces)
are counted and divided by the host's pages; a line above the boilerplate
ratio, on at least ``min_pages`` pages, is dropped from all pages of the host.
Counts are combined map-side; the join of lines with boilerplate lines is an
ordinary shuffle join whose hot keys adaptive execution splits.

Defined results: a null host is a host of its own; a null text has no lines
and stays null, an empty text has one blank line; blank lines are neither
counted nor dropped; a line repeated within a page counts that page once;
repeated rows are pages of their own; clashing input columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import free_name, group_key, without


def _lines(text: str):
    return F.split(F.col(text), "\n", -1)


def _mark(line):
    """128 bits that stand for a line; null for a blank one."""
    line = F.trim(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")))


def boilerplate(pages: DataFrame, key: str, marks: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(key, mark, n, pages): lines on more than ``max_ratio`` of a host's pages."""
    per_host = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"))
    per_line = (pages.select(key, F.explode(F.array_distinct(F.filter(marks, lambda m: m.isNotNull())))
                             .alias("mark"))
                .groupBy(key, "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    return per_line.join(per_host, key).where(F.col("n") > F.col("pages") * F.lit(max_ratio))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text",
                     id_col: str = "doc_id", max_ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """``pages`` with n_lines and n_dropped; the text column holds the kept lines."""
    used = {host_col.lower(), text_col.lower(), id_col.lower()}
    pages = without(pages, [c for c in ("n_lines", "n_dropped") if c not in used])
    key, row, marks, flags = (free_name(pages, x) for x in ("_key", "_row", "_marks", "_flags"))
    # a row's key is its id, host and content: rows equal in all of them get equal flags
    content = F.col(text_col)
    keyed = pages.withColumns({
        key: group_key(F.col(host_col)),
        row: F.struct(F.xxhash64(F.lit(0), F.col(id_col), F.col(host_col), content).alias("a"),
                      F.xxhash64(F.lit(1), F.col(id_col), F.col(host_col), content).alias("b"))})
    slim = keyed.select(key, row, F.transform(_lines(text_col), _mark).alias(marks))
    bad = boilerplate(slim, key, marks, max_ratio, min_pages).select(key, "mark", F.lit(True).alias("bad"))
    each = slim.select(key, row, F.posexplode(marks).alias("pos", "mark"))
    flagged = (each.join(bad, [key, "mark"], "left")
               .groupBy(row).agg(F.sort_array(F.collect_set(F.struct(
                   "pos", F.coalesce("bad", F.lit(False)).alias("bad")))).alias(flags)))
    keep = F.filter(_lines(text_col), lambda x, i: ~F.col(flags)[i]["bad"])
    out = keyed.join(flagged, row, "left")
    return (out.withColumn("n_lines", F.coalesce(F.array_size(_lines(text_col)), F.lit(0)).cast("long"))
            .withColumn("n_dropped", F.coalesce(F.array_size(F.filter(flags, lambda f: f["bad"])),
                                                F.lit(0)).cast("long"))
            .withColumn(text_col, F.array_join(keep, "\n")).drop(key, row, flags))

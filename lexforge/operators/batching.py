"""Loader semantics as table operators (survey D5, D6, K2, K3, K6, K7, C2, G3).

The reference loader walks files in a seeded order, shuffles each file's rows,
carries the remainder across file borders and cuts fixed-size batches.  As a
table that is one dense position per example and epoch:

``pos = offset(file) + rank_in_file``; ``batch_id = pos // B``.

``offset(file)`` is an exclusive prefix sum over the file manifest (one row
per file, small), ``rank_in_file`` a seeded hash rank per file that is split
into hash buckets, so a file holding a large share of all rows still spreads
over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.positions import ordered_running
from lexforge.operators.sampling import shuffle_positions
from lexforge.operators.vocab import PAD_ID


def file_manifest(tokens: DataFrame, file_col: str = "rel_path") -> DataFrame:
    """Manifest ``(rel_path, n_rows)`` of a token table (one row per file)."""
    return tokens.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_rows"))


def file_order(manifest: DataFrame, seed: int, shuffle: bool = True,
               file_col: str = "rel_path", epoch_col: str | None = None) -> DataFrame:
    """File rank (seeded hash order, or path order when not shuffled) and
    the first example position of each file (``file_offset``).  The order is
    the same every epoch, as in the reference."""
    part = [epoch_col] if epoch_col else []
    if shuffle:
        ranked = shuffle_positions(manifest, file_col, seed, "file_rank", partition=part, digits=2)
        order = ["file_rank"]
    else:
        ranked = manifest
        order = [file_col]
    return ordered_running(ranked, order, part, pos_col="file_rank" if not shuffle else None,
                           sums={"file_offset": "n_rows"})


def epoch_positions(tokens: DataFrame, n_epochs: int = 1, seed: int = 0,
                    shuffle_files: bool = True, shuffle_contents: bool = True,
                    file_col: str = "rel_path", row_col: str = "row",
                    example_col: str = "example_id") -> DataFrame:
    """D5 + D6 + K6: dense position of every example in every epoch.

    Epochs repeat the whole table (``explode(sequence)``, not a join); the
    in-file order is re-drawn per epoch from ``md5(seed:epoch:file:row)``.
    """
    ep = tokens.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
    manifest = file_manifest(tokens, file_col)
    files = file_order(manifest, seed, shuffle_files, file_col)
    if shuffle_contents:
        ranked = shuffle_positions(ep, [file_col, row_col], seed, "rank_in_file",
                                   partition=["epoch", file_col],
                                   key_parts=["epoch", file_col, row_col], digits=2)
    else:
        ranked = ordered_running(ep, [F.col(row_col)], ["epoch", file_col], pos_col="rank_in_file")
    # the manifest is one row per file; AQE broadcasts it when it is small
    joined = ranked.join(files.select(file_col, "file_offset"), file_col)
    # every epoch holds the whole table: its size is one scalar subquery
    n_rows = tokens.agg(F.count(F.lit(1))).scalar()
    return (joined.withColumn("pos", F.col("file_offset") + F.col("rank_in_file"))
            .withColumn("n_in_epoch", n_rows).drop("file_offset"))


def assign_batches(positioned: DataFrame, batch_size: int, drop_last: bool = True,
                   pos_col: str = "pos", part=("epoch",), size_col: str = "n_in_epoch") -> DataFrame:
    """K2 (drop_last) / K3 (keep_last): ``batch_id = pos // B``; with
    ``drop_last`` the trailing partial batch of each epoch is removed.

    The epoch size comes from ``size_col`` when present (set by
    :func:`epoch_positions`); otherwise from a per-epoch count that is
    broadcast (one row per epoch).  Never a join keyed on the epoch alone,
    which would send a whole epoch to one task."""
    out = positioned.withColumns({"batch_id": F.floor(F.col(pos_col) / batch_size).cast("long"),
                                  "batch_pos": (F.col(pos_col) % batch_size).cast("int")})
    if drop_last:
        if size_col in positioned.columns:
            n = F.col(size_col)
        else:
            sizes = positioned.groupBy(*part).agg(F.count(F.lit(1)).alias("_n_epoch"))
            out = out.join(F.broadcast(sizes), list(part))
            n = F.col("_n_epoch")
        out = out.where(F.col("batch_id") < F.floor(n / batch_size)).drop("_n_epoch")
    return out.drop(size_col) if size_col in out.columns else out


FILES_PER_CHUNK = 10_000


def _after(carry, n, batch_size: int):
    """(rows carried on, batches given out) by a file of ``n`` rows that starts with ``carry`` rows.

    A file that does not fill a batch gives out what there is as a short one."""
    total = carry + n
    short = (total < batch_size) & (total > 0)
    return np.where(short, 0, total % batch_size), np.where(short, 1, total // batch_size)


def loader_files(manifest: DataFrame, batch_size: int, rank_col: str = "file_rank",
                 rows_col: str = "n_rows") -> DataFrame:
    """K3 as the one-file-at-a-time loader cuts it: ``manifest`` (ranked, one row a
    file) with ``carry_in``, the rows left over from files before, ``first_batch`` and
    ``n_batches``.

    The loader is a fold over the files whose state is the carry, one of
    ``batch_size`` values; so a stretch of files is a table from each carry in to the
    carry out and the batches between.  Stretches of ``FILES_PER_CHUNK`` files are
    folded to such tables in parallel, the tables (one a stretch) are composed, and
    each stretch then numbers its files from its known start."""
    files = manifest.withColumn("_chunk", F.floor(F.col(rank_col) / FILES_PER_CHUNK).cast("long"))

    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        carry, batches = np.arange(batch_size), np.zeros(batch_size, dtype=np.int64)
        for n in rows.sort_values(rank_col)[rows_col].tolist():
            carry, more = _after(carry, n, batch_size)
            batches = batches + more
        return pd.DataFrame({"chunk": [key[0]], "carry": [carry], "batches": [batches]})

    # one row for FILES_PER_CHUNK files
    tables = (files.select("_chunk", rank_col, rows_col).groupBy("_chunk")
              .applyInPandas(table, "chunk long, carry array<long>, batches array<long>").collect())
    start, carry, first = {}, 0, 0
    for t in sorted(tables, key=lambda t: t["chunk"]):
        start[t["chunk"]] = (carry, first)
        carry, first = t["carry"][carry], first + t["batches"][carry]

    def number(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        carry, first = start[key[0]]
        rows = rows.sort_values(rank_col)
        out = []
        for n in rows[rows_col].tolist():
            after, batches = (int(x) for x in _after(carry, n, batch_size))
            out.append((carry, first, batches))
            carry, first = after, first + batches
        rows[["carry_in", "first_batch", "n_batches"]] = np.array(out, dtype=np.int64).reshape(-1, 3)
        return rows.drop(columns="_chunk")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema.fields)
    return files.groupBy("_chunk").applyInPandas(number, f"{kinds}, carry_in long, first_batch long, n_batches long")


def loader_batches(ranked: DataFrame, files: DataFrame, batch_size: int, file_col: str = "rel_path") -> DataFrame:
    """``ranked`` (rows with ``rank_in_file``) with batch_id and batch_pos by the files of
    :func:`loader_files`; rows that a file leaves over open the next file's first batch."""
    at = F.col("carry_in") + F.col("rank_in_file")
    return (ranked.join(files.select(file_col, "carry_in", "first_batch"), file_col)
            .withColumns({"batch_id": F.col("first_batch") + F.floor(at / batch_size).cast("long"),
                          "batch_pos": (at % batch_size).cast("int")}).drop("carry_in", "first_batch"))


def file_counters(files: DataFrame, batch_size: int, rank_col: str = "file_rank", rows_col: str = "n_rows") -> DataFrame:
    """G3 per file: for every batch that a file gives out, how many batches and examples
    the file has given out by then.  What the last file leaves over is one batch more,
    of no file (its rank is the number of files), counted on from the last file."""
    left = F.when((F.col("carry_in") + F.col(rows_col)) < batch_size, F.lit(0)).otherwise(
        (F.col("carry_in") + F.col(rows_col)) % batch_size)
    full = F.col("carry_in") + F.col(rows_col) - left                # examples given out by the file
    f = files.withColumns({"left": left, "given": full})
    each = (f.where("n_batches > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_batches"))))
            .select((F.col("first_batch") + F.col("i") - 1).alias("batch_id"), F.col(rank_col).alias("file_idx"),
                    F.col("i").alias("file_batches"),
                    F.least(F.col("i") * batch_size, F.col("given")).alias("file_examples"),
                    F.least(F.lit(batch_size).cast("long"), F.col("given") - (F.col("i") - 1) * batch_size).alias("n_examples")))
    last = f.orderBy(F.desc(rank_col)).limit(1).where("left > 0")
    tail = last.select((F.col("first_batch") + F.col("n_batches")).alias("batch_id"), (F.col(rank_col) + 1).alias("file_idx"),
                       (F.col("n_batches") + 1).alias("file_batches"), (F.col("given") + F.col("left")).alias("file_examples"),
                       F.col("left").alias("n_examples"))
    return each.unionByName(tail)


def drop_all_pad(df: DataFrame, ids_col: str = "ids", pad_id: int = PAD_ID) -> DataFrame:
    """Remove examples whose ids are all ``[PAD]`` (applied after
    batching, so counters still use the pre-filter batch size)."""
    return df.where(F.exists(F.col(ids_col), lambda x: x != pad_id))


def batch_counters(batches: DataFrame, part=("epoch",)) -> DataFrame:
    """Per batch, the loader counters - examples in the batch, batches and
    examples returned so far in this epoch (inclusive) and overall."""
    per_batch = batches.groupBy(*part, "batch_id").agg(F.count(F.lit(1)).alias("n_examples"))
    r = ordered_running(per_batch, [F.col(p) for p in part] + [F.col("batch_id")], [],
                        pos_col="global_batches_before", sums={"global_examples_before": "n_examples"})
    r = ordered_running(r, [F.col("batch_id")], list(part), pos_col="epoch_batches_before",
                        sums={"epoch_examples_before": "n_examples"})
    return r.select(*part, "batch_id", "n_examples",
                    (F.col("epoch_batches_before") + 1).alias("epoch_batches"),
                    (F.col("epoch_examples_before") + F.col("n_examples")).alias("epoch_examples"),
                    (F.col("global_batches_before") + 1).alias("global_batches"),
                    (F.col("global_examples_before") + F.col("n_examples")).alias("global_examples"))


def missing_files(manifest: DataFrame, listing: DataFrame, file_col: str = "rel_path") -> DataFrame:
    """K7: files named in a saved state that are not present in the listing
    (anti-join); a non-empty result means the state cannot be resumed."""
    return manifest.join(listing.select(file_col), file_col, "left_anti")


def require_files(manifest: DataFrame, listing: DataFrame, file_col: str = "rel_path") -> None:
    """K7 as a guard: raise FileNotFoundError naming one missing file."""
    missing = missing_files(manifest, listing, file_col).select(file_col).take(1)
    if missing:
        raise FileNotFoundError(f"the saved state needs {missing[0][0]}, which the token folder lacks")

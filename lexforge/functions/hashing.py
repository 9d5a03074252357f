"""Reproducible pseudo-randomness from md5 (survey D1, D2, D4-D6, M1-M3).

``rand()`` changes when a task is retried or a plan is re-optimised; a hash
of (seed, key) does not, and DuckDB computes the same bits, which makes the
randomised operators checkable against an SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_key(seed, *parts) -> Column:
    """md5 hex of ``seed:part1:part2...`` (all rendered as strings)."""
    items = [F.lit(str(seed))]
    for p in parts:
        items.append(F.lit(":"))
        items.append((F.col(p) if isinstance(p, str) else p).cast("string"))
    return F.md5(F.concat(*items))


def hex_uniform(hex_col: Column, k: int) -> Column:
    """k-th (1..4) independent uniform in [0, 1) from a 32-hex-digit md5."""
    start = 8 * (k - 1) + 1
    return F.conv(F.substring(hex_col, start, 8), 16, 10).cast("long") / F.lit(TWO_32)


def hex_bucket(hex_col: Column, digits: int) -> Column:
    """Leading ``digits`` hex digits as an int: a range bucket of the md5 order."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")

"""Deterministic shuffling: md5 keys, ranks without a single-partition sort.

``rand(seed)`` changes with the partitioning, so every random order here is the order of ``md5('<seed>:<tag>:<id>')``, with
the id as tie-break: the same on any cluster, in any engine, and on the driver (``key_of``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Plan-sized tables up to so many rows are ranked by one window; larger ones in ranges of their keys.
ONE_WINDOW_ROWS = 1_000_000
#: Rows of one range, about.
RANGE_ROWS = 65_536


def key_of(seed: int | str, tag: str, *ids: int) -> str:
    return hashlib.md5(":".join([str(seed), tag, *map(str, ids)]).encode()).hexdigest()


def hash_key(seed: int | str, tag: str, *ids: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{tag}"), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in ids)))


def lead(key: Column, digits: int = 8) -> Column:
    """The key's first hexadecimal digits as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def below(key: Column, n: int | Column) -> Column:
    """A number in [0, n) from a key."""
    return lead(key) % n


def ranked(df: DataFrame, key: str, n_rows: int, name: str, ties: list[str], within: list[str] | None = None, n_groups: int = 1) -> DataFrame:
    """df with ``name``: its 0-based rank by (key, ties), globally or within groups; key: hexadecimal, uniform.

    Small tables take one window. Large ones are cut by the keys' leading bits into ranges: ranks within a range are a window over
    (within, range), and the ranges' offsets, one row for about 65,536 rows, are prefix sums joined back. n_groups: groups of about
    equal size; what counts as large is one group.
    """
    within = within or []
    groups = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    n_rows = -(-n_rows // max(1, n_groups))
    if n_rows <= ONE_WINDOW_ROWS:
        return df.withColumn(name, (F.row_number().over(groups.orderBy(key, *ties)) - 1).cast("long"))
    bits = min(24, (n_rows // RANGE_ROWS).bit_length())
    cut = df.withColumn("_range", F.shiftright(lead(F.col(key)), 32 - bits))
    count = cut.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    base = count.select(*within, "_range", F.coalesce(F.sum("_n").over(groups.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = W.partitionBy(*within, "_range").orderBy(key, *ties)
    return cut.join(base, [*within, "_range"]).withColumn(name, (F.col("_base") + F.row_number().over(inner) - 1).cast("long")).drop("_range", "_base")

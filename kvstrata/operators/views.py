"""Views over versioned keys: newest, live, all versions; ordered merges of streams.

"Newest per key" is a max_by aggregate, so partial results are combined before the shuffle and a
key with very many versions doesn't meet in one task. Flags on every version join that result back,
which adaptive execution can split where a key is hot; nothing is ranked in one window per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str = "key", order: tuple[str, ...] = ("run", "seq")) -> DataFrame:
    """One row per key, the one with the greatest order; tombstones stay."""
    rest = [c for c in rows.columns if c != key]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return rows.groupBy(key).agg(top).select(key, "__r.*").select(*rows.columns)


def live(rows: DataFrame, key: str = "key", order: tuple[str, ...] = ("run", "seq"), tombstone: str | Column = "tombstone") -> DataFrame:
    """Newest rows that aren't tombstones. Older versions never show through a tombstone."""
    gone = F.col(tombstone) if isinstance(tombstone, str) else tombstone
    return newest(rows, key, order).filter(~gone)


def all_versions(rows: DataFrame, key: str = "key", order: tuple[str, ...] = ("run", "seq")) -> DataFrame:
    """Every row with `stale`: a newer version of its key exists."""
    top = rows.groupBy(F.col(key).alias("__k")).agg(F.max(F.struct(*order)).alias("__top"))
    return rows.join(top, F.col(key).eqNullSafe(F.col("__k"))).withColumn("stale", F.struct(*order) < F.col("__top")).drop("__k", "__top")


def merge(*streams: DataFrame) -> DataFrame:
    """All rows of all streams with `rank`, the number of their stream: a later stream wins a tie."""
    return reduce(DataFrame.unionByName, (s.withColumn("rank", F.lit(i)) for i, s in enumerate(streams)))


def merge_ordered(*streams: DataFrame, key: str = "key") -> DataFrame:
    return merge(*streams).orderBy(key, F.desc("rank"))


def merge_unique(*streams: DataFrame, key: str = "key") -> DataFrame:
    """The winning row of each key and which stream it came from."""
    return ranked_unique(merge(*streams), key)


def merge_history(*streams: DataFrame, key: str = "key") -> DataFrame:
    """Every row with `rank` and `repeated`: an equal key of a later stream goes first."""
    return ranked_history(merge(*streams), key)


def ranked_unique(ranked: DataFrame, key: str = "key") -> DataFrame:
    """merge_unique of a frame whose rows have the `rank` of their stream, of which there may be any number."""
    return newest(ranked, key, ("rank",))


def ranked_history(ranked: DataFrame, key: str = "key") -> DataFrame:
    """merge_history of a frame whose rows have the `rank` of their stream, of which there may be any number."""
    return all_versions(ranked, key, ("rank",)).withColumnRenamed("stale", "repeated")


def partial_merge(rows: DataFrame, least_run: int, key: str = "key") -> DataFrame:
    """Newest among the runs from `least_run` on; tombstones stay, as older runs may hold the key."""
    return newest(rows.filter(F.col("run") >= least_run), key)


def incremental(old_newest: DataFrame, delta: DataFrame, key: str = "key") -> DataFrame:
    """Newest view after new runs, from the old view: only keys in the delta change."""
    return newest(old_newest.unionByName(delta), key)


def tiers(*layers: DataFrame, key: str = "key") -> DataFrame:
    """Live rows of a store and the memory tables above it, given from old to new."""
    return live(merge(*layers), key, ("rank",))


def run_overlap(rows: DataFrame, key: str = "key") -> DataFrame:
    """Per run its first and last key and whether it begins at or before the last key of the runs before it."""
    ends = rows.groupBy("run").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    # One row per run: at most MAX_RUNS, so the window has a bounded number of rows.
    before = F.lag("last_key").over(Window.orderBy("run"))
    return ends.withColumn("overlaps", F.coalesce(F.col("first_key") <= before, F.lit(False)))

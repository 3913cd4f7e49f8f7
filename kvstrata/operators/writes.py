"""Writes as frames of mutations: nothing is changed in place, a newer version is added.

A delete writes its tombstone whether or not the key exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import checked


def put(rows: DataFrame, run: int, seq: str | Column = "seq") -> DataFrame:
    """(key, value) as mutations of a run."""
    order = F.col(seq) if isinstance(seq, str) else seq
    return checked(rows.select("key", "value", F.lit(False).alias("tombstone"), F.lit(run).alias("run"), order.alias("seq")))


def delete(keys: DataFrame, run: int, seq: str | Column = "seq", value_type: str = "binary") -> DataFrame:
    order = F.col(seq) if isinstance(seq, str) else seq
    return checked(keys.select("key", F.lit(None).cast(value_type).alias("value"), F.lit(True).alias("tombstone"), F.lit(run).alias("run"), order.alias("seq")))


def deleted(view: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The view without the keys, and the keys that were there."""
    return view.join(keys, "key", "left_anti"), view.join(keys, "key", "left_semi").select("key")


def delete_range(view: DataFrame, start=None, end=None, name: str = "key") -> tuple[DataFrame, DataFrame]:
    """The view without start <= key < end (None: open), and the rows that go."""
    inside = F.lit(True)
    if start is not None:
        inside &= F.col(name) >= F.lit(start)
    if end is not None:
        inside &= F.col(name) < F.lit(end)
    return view.filter(~inside), view.filter(inside)


def read_modify_write(updates: DataFrame, view: DataFrame, combine, run: int) -> DataFrame:
    """New versions from combine(old value, argument), where old is null for an absent key.

    updates: (key, seq, argument). Updates of one key apply in seq order, each to the result of the
    one before, so they meet in one row; where combine is a sum, add_up doesn't gather them. A null
    result leaves the key as it is.
    """
    per_key = updates.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "argument"))).alias("todo"))
    joined = per_key.join(view.select("key", F.col("value").alias("__old")), "key", "left")
    kind = view.schema["value"].dataType
    value = F.aggregate("todo", F.col("__old"), lambda old, u: F.coalesce(combine(old, u["argument"]).cast(kind), old))
    last = F.element_at("todo", -1)["seq"]
    done = joined.select("key", value.alias("value"), F.lit(False).alias("tombstone"), F.lit(run).alias("run"), last.alias("seq"), F.col("__old"))
    return done.filter(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("__old"))).drop("__old")


def add_up(updates: DataFrame, view: DataFrame, run: int) -> DataFrame:
    """Read-modify-write for sums: adds are combined before the shuffle, so hot keys don't gather."""
    total = updates.groupBy("key").agg(F.sum("argument").alias("__add"), F.max("seq").alias("seq"))
    joined = total.join(view.select("key", F.col("value").alias("__old")), "key", "left")
    return joined.select("key", (F.coalesce("__old", F.lit(0)) + F.col("__add")).alias("value"), F.lit(False).alias("tombstone"), F.lit(run).alias("run"), "seq")


def write_in_place(view: DataFrame, keys: DataFrame, expression: Column, name: str = "key") -> DataFrame:
    """The view with `value` replaced for the keys that are there; absent keys change nothing."""
    marked = view.join(keys.select(name).distinct().withColumn("__hit", F.lit(True)), name, "left")
    return marked.withColumn("value", F.when(F.col("__hit"), expression).otherwise(F.col("value"))).select(*view.columns)


def worker_share(n: int, workers: int, worker: int) -> tuple[int, int]:
    """Ids [a, b) of a worker; the last one takes the remainder."""
    each = n // workers
    return worker * each, n if worker == workers - 1 else (worker + 1) * each


def bulk(spark, n: int, workers: int) -> DataFrame:
    """(id, worker) for ids 0 .. n-1, split among the workers as worker_share does."""
    each = max(n // workers, 1)
    return spark.range(n).withColumn("worker", F.least(F.floor(F.col("id") / each), F.lit(workers - 1)).cast("int"))


def reinsert(rejected: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rejected mutations back under the fresh ones, never over a newer version of their key."""
    return rejected.join(fresh.select("key").distinct(), "key", "left_anti").unionByName(fresh)


def last_of_each(log: DataFrame, key: str = "key", order: tuple[str, ...] = ("epoch", "seq")) -> DataFrame:
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*").select(*log.columns)


def valid_prefix(log: DataFrame, ok: str = "checksum_ok") -> DataFrame:
    """Per epoch the records before its first bad one."""
    bad = log.filter(~F.col(ok)).groupBy("epoch").agg(F.min("seq").alias("__bad"))
    return log.join(bad, "epoch", "left").filter(F.col("__bad").isNull() | (F.col("seq") < F.col("__bad"))).drop("__bad")


def replay(log: DataFrame, key: str = "key") -> DataFrame:
    """The state after a crash: valid records of the older log, then of the newer one; the last per key."""
    return last_of_each(valid_prefix(log), key)

"""Point and range reads, single and in batches, over a live or newest view.

Single reads are filters that reach the Parquet scan. Batches are joins: of keys for get and probe,
and of dense ranks for range reads. The rank of "first key at or after k" comes from a count inside
k's range partition, so each operation costs its own result rows and nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import globally_ranked

#: Anchors that a plan may hold as a literal.
LITERAL_ANCHORS = 2_000

def get(view: DataFrame, key, name: str = "key") -> DataFrame:
    return view.filter(F.col(name) == F.lit(key))


def probe(view: DataFrame, key, name: str = "key") -> bool:
    return not get(view, key, name).limit(1).isEmpty()


def batch_get(keys: DataFrame, view: DataFrame, name: str = "key") -> DataFrame:
    """Every key with its row; nulls where it isn't there."""
    return keys.join(view, name, "left")


def batch_probe(keys: DataFrame, view: DataFrame, name: str = "key") -> DataFrame:
    return keys.join(view.select(name), name, "left_semi")


def batch_miss(keys: DataFrame, view: DataFrame, name: str = "key") -> DataFrame:
    return keys.join(view.select(name), name, "left_anti")


def read_in_place(keys: DataFrame, view: DataFrame, expression, name: str = "key") -> DataFrame:
    """An expression over each key's row, which is all nulls where the key isn't there."""
    return keys.join(view, name, "left").withColumn("result", expression)


def first_last(rows: DataFrame, name: str = "key") -> DataFrame:
    """Smallest and largest key, tombstones included."""
    return rows.agg(F.min(name).alias("first_key"), F.max(name).alias("last_key"))


def seek(view: DataFrame, key, n: int = 1, skip: int = 0, name: str = "key") -> DataFrame:
    """n rows from the first key at or after `key`, after skipping some."""
    return view.filter(F.col(name) >= F.lit(key)).orderBy(name).offset(skip).limit(n)


def seek_first(view: DataFrame, n: int = 1, name: str = "key") -> DataFrame:
    return view.orderBy(name).limit(n)


def seek_at_most(view: DataFrame, key, n: int = 1, name: str = "key") -> DataFrame:
    """The last key at or before `key`, and those before it."""
    return view.filter(F.col(name) <= F.lit(key)).orderBy(F.desc(name)).limit(n)


def seek_near(view: DataFrame, current, key, n: int = 1, name: str = "key") -> DataFrame:
    """Forward only: from `current` on where `key` lies behind it."""
    return seek(view, max(current, key), n, name=name)


def scan(view: DataFrame, start=None, end=None, name: str = "key") -> DataFrame:
    """Rows with start <= key < end in order; None leaves that side open."""
    if start is not None:
        view = view.filter(F.col(name) >= F.lit(start))
    if end is not None:
        view = view.filter(F.col(name) < F.lit(end))
    return view.orderBy(name)


def locate(keys: DataFrame, anchors: DataFrame, name: str = "key") -> DataFrame:
    """Each key with part_id and anchor of its partition: the largest anchor at or before it.

    anchors: (part_id, anchor), one row per range partition. Up to LITERAL_ANCHORS of them are put in
    one array and searched by halving, so the keys aren't moved; more are merged with the keys in key order.
    """
    if anchors.count() > LITERAL_ANCHORS:
        return _located_in_order(keys, anchors, name)
    table = sorted((r["anchor"], r["part_id"]) for r in anchors.select("anchor", "part_id").collect())
    if not table:
        return keys.withColumn("part_id", F.lit(None).cast("int")).withColumn("anchor", F.lit(None).cast(keys.schema[name].dataType))
    kind = keys.schema[name].dataType
    bounds = F.array(*(F.lit(a).cast(kind) for a, _ in table))
    at = count_at_most(F.col(name), bounds, len(table))
    hit = at > 0
    place = F.greatest(at, F.lit(1))
    parts = F.array(*(F.lit(p) for _, p in table))
    return keys.withColumn("part_id", F.when(hit, F.element_at(parts, place))).withColumn("anchor", F.when(hit, F.element_at(bounds, place)))


def _located_in_order(keys: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    """The same by one range partitioning of keys and anchors together; a range's last anchor goes on to the next ones."""
    kind = keys.schema[name].dataType
    at = F.struct(F.col("part_id"), F.col("anchor").cast(kind).alias("anchor"))
    marks = anchors.select(F.col("anchor").cast(kind).alias(name), F.lit(0).alias("__key"), at.alias("__at"))
    both = keys.withColumn("__key", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    ranked = globally_ranked(both, name, "__key")
    found = dict(ranked.filter("__key = 0").groupBy("pid").agg(F.max("rank")).collect())  # a row a range
    before = [max((r for p, r in found.items() if p < pid), default=-1) for pid in range(max(found) + 2)]
    carried = ranked.filter(F.col("rank").isin([r for r in before if r >= 0]) & (F.col("__key") == 0)).select(F.col("rank").alias("__from"), F.col("__at").alias("__carried"))
    start = F.element_at(F.array(*map(F.lit, before)), F.least(F.col("pid") + 1, F.lit(len(before)))).cast("long")
    window = Window.partitionBy("pid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = ranked.withColumn("__own", F.last("__at", True).over(window)).withColumn("__from", start)
    joined = own.filter("__key = 1").join(F.broadcast(carried), "__from", "left")  # a row a range
    here = F.coalesce("__own", "__carried")
    return joined.select(*keys.columns, here["part_id"].alias("part_id"), here["anchor"].alias("anchor"))


def count_at_most(value, bounds, size: int):
    """How many of the sorted bounds are at most the value, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / F.lit(2)).cast("int")
        open_ = s["lo"] < s["hi"]
        low = open_ & (F.element_at(bounds, F.least(mid + 1, F.lit(size))) <= value)
        return F.struct(F.when(low, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~low, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(size.bit_length())), start, halve)["lo"]


def successor_ranks(keys: DataFrame, ranked: DataFrame, name: str = "key") -> DataFrame:
    """Distinct keys with the rank of the first row at or after each (the row count if there is none).

    ranked: from globally_ranked. A key's partition is found among the partitions' first keys, and
    inside it the rows below the key are counted in one sorted pass.
    """
    firsts = sorted((r["k"], r["pid"], r["r"]) for r in ranked.groupBy("pid").agg(F.min(name).alias("k"), F.min("rank").alias("r")).collect())
    kind = keys.schema[name].dataType
    wanted = keys.select(name).distinct()
    if not firsts:
        return wanted.withColumn("rank", F.lit(0).cast("long"))
    bounds = F.array(*(F.lit(k).cast(kind) for k, _, _ in firsts))
    place = F.greatest(count_at_most(F.col(name), bounds, len(firsts)), F.lit(1))
    pids, base = F.array(*(F.lit(p) for _, p, _ in firsts)), F.array(*(F.lit(r) for _, _, r in firsts)).cast("array<bigint>")
    asked = wanted.select(F.element_at(pids, place).alias("pid"), F.col(name), F.lit(0).alias("is_row"), F.element_at(base, place).alias("base"))
    there = ranked.select("pid", F.col(name), F.lit(1).alias("is_row"), F.lit(None).cast("long").alias("base"))
    below = F.sum("is_row").over(Window.partitionBy("pid").orderBy(name, "is_row").rowsBetween(Window.unboundedPreceding, 0))
    return asked.union(there).withColumn("below", below).filter("is_row = 0").select(name, (F.col("base") + F.col("below")).alias("rank"))


def batch_range(ops: DataFrame, view: DataFrame, name: str = "key") -> DataFrame:
    """For every op (op_id, key, skip, n): the n rows after skipping `skip` from its key on.

    Returns op_id, step (0-based place within the op) and the columns of the view.
    """
    ranked = globally_ranked(view, name)
    starts = successor_ranks(ops, ranked, name)
    wanted = ops.join(starts, name).filter("n > 0").select("op_id", F.explode(F.sequence(F.col("rank") + F.col("skip"), F.col("rank") + F.col("skip") + F.col("n") - 1)).alias("rank"), (F.col("rank") + F.col("skip")).alias("__from"))
    out = wanted.select("op_id", "rank", (F.col("rank") - F.col("__from")).cast("int").alias("step"))
    return out.join(ranked.drop("pid"), "rank").select("op_id", "step", *view.columns)

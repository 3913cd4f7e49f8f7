"""Workloads: operation mixes, passes over workers, run placement and key sets for look-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generators, keys
from ..session import materialise
from . import reads, views

# Operation codes and the mixes of the six standard workloads, in per cent.
OP_CODES = {"s": "set", "d": "del", "g": "get", "p": "probe", "n": "seeknext", "k": "seekskip"}
PARTITIONED_CODES = ("S", "D", "P", "G")
SCALE = 65_536


@dataclass(frozen=True)
class Mix:
    set: int
    update: int
    get: int
    scan: int
    nscan: int
    distribution: str


MIXES = {
    "A": Mix(50, 0, 50, 0, 10, "unizipf"),
    "B": Mix(5, 0, 95, 0, 10, "unizipf"),
    "C": Mix(0, 0, 100, 0, 10, "unizipf"),
    "D": Mix(5, 0, 95, 0, 10, "latest"),
    "E": Mix(5, 0, 0, 95, 50, "unizipf"),
    "F": Mix(0, 50, 50, 0, 10, "unizipf"),
}


def worker_seed(worker):
    return (worker + 73) * 117


def chosen_op(draw, mix: Mix):
    """The operation for a draw in [0, 65536): gets, then scans, then sets, the rest updates."""
    get, scan, put = (x * SCALE // 100 for x in (mix.get, mix.get + mix.scan, mix.get + mix.scan + mix.set))
    return F.when(draw < get, "get").when(draw < scan, "scan").when(draw < put, "set").otherwise("update")


def ycsb_ops(spark: SparkSession, n: int, workers: int, mix: Mix, low: int, high: int, hills: int = 1000) -> DataFrame:
    """(op_id, worker, op, number, n) of n operations for each worker."""
    rows = spark.range(n * workers).select(F.floor(F.col("id") / n).cast("int").alias("worker"), F.pmod("id", F.lit(n)).alias("op_id"))
    seed = worker_seed(F.col("worker").cast("long"))
    rows = rows.withColumn("h", F.xxhash64(seed, "op_id")).withColumn("draw", F.pmod("h", F.lit(SCALE)))
    rows = rows.withColumn("op", chosen_op(F.col("draw"), mix))
    if mix.distribution == "latest":
        rows = generators.latest(rows.withColumn("w", F.col("op").isin("set", "update")), "op_id", "w", "worker", hills, low)
    else:
        rows = rows.withColumn("number", generators.uniform_zipfian(F.col("h"), low, high, hills))
    return rows.select("op_id", "worker", "op", "number", F.when(F.col("op") == "scan", mix.nscan).otherwise(1).alias("n"))


def pass_ops(spark: SparkSession, code: str, n: int, workers: int, distribution: str) -> DataFrame:
    """(op_id, worker, op, number): a pass of one operation; S D P G give each worker its own id range."""
    partitioned = code in PARTITIONED_CODES
    op = OP_CODES[code.lower()]
    rows = spark.range(n)
    if partitioned:
        each = max(n // workers, 1)
        return rows.select(F.col("id").alias("op_id"), F.least(F.floor(F.col("id") / each), F.lit(workers - 1)).cast("int").alias("worker"), F.lit(op).alias("op"), F.col("id").alias("number"))
    draw = generators.parse(distribution)
    return rows.select(F.col("id").alias("op_id"), F.pmod("id", F.lit(workers)).cast("int").alias("worker"), F.lit(op).alias("op"), draw(F.col("id")).alias("number"))


def op_counts(ops: DataFrame, ok: str = "ok", nsec: float | None = None) -> DataFrame:
    """Per operation how many were tried and succeeded, and millions a second if the time is known."""
    out = ops.groupBy("op").agg(F.count("*").alias("attempted"), F.sum(F.when(F.col(ok), 1).otherwise(0)).alias("succeeded"))
    return out if nsec is None else out.withColumn("mops", F.col("attempted") * 1000.0 / F.lit(float(nsec)))


def run_levels(keys_df: DataFrame, nway: int, seed: int = 0) -> DataFrame:
    """Each key with two draws from [0, 2 nway); a draw below nway puts it in that run (75 % have one)."""
    draw = lambda salt: F.pmod(F.xxhash64("key", F.lit(seed), F.lit(salt)), F.lit(2 * nway)).cast("int")
    return keys_df.withColumn("level1", draw(1)).withColumn("level2", draw(2)).withColumn("inserted", (F.col("level1") < nway) | (F.col("level2") < nway))


def run_records(levels: DataFrame, nway: int) -> DataFrame:
    """(key, run): one row for each run that a key was put in."""
    runs = F.array_distinct(F.array("level1", "level2"))
    return levels.select("key", F.explode(F.filter(runs, lambda r: r < nway)).alias("run"))


def key_sets(levels: DataFrame, mode: str) -> DataFrame:
    """Keys to look up: existing, missing or mixed."""
    return {"existing": levels.filter("inserted"), "missing": levels.filter("not inserted"), "mixed": levels}[mode].select("key")


def bench_keys(spark: SparkSession, n: int, klen: int = 16, distribution: str = "shuffle") -> DataFrame:
    """(id, key): n generated keys as hex text."""
    draw = generators.parse(f"{distribution} 0 {n - 1}")
    return spark.range(n).select(draw(F.col("id")).alias("id")).withColumn("key", keys.hex_key("id", klen))


def execute(ops: DataFrame, view: DataFrame) -> DataFrame:
    """(op_id, op, ok) of every operation against one snapshot.

    ops: op_id, op, key, n. Reads succeed if they find a row: gets and probes by a join, "seeknext"
    and "scan" in the n rows from their key on, "seekskip" in the row after skipping n. Writes are
    blind and succeed.
    """
    point = ops.filter(F.col("op").isin("get", "probe"))
    there = view.select("key", F.lit(True).alias("__hit"))
    points = point.join(there, "key", "left").select("op_id", "op", F.coalesce("__hit", F.lit(False)).alias("ok"))
    ranged = ops.filter(F.col("op").isin("seeknext", "seekskip", "scan"))
    skips = F.col("op") == "seekskip"
    asked = ranged.select("op_id", "key", F.when(skips, F.col("n")).otherwise(0).alias("skip"), F.when(skips, 1).otherwise(F.greatest("n", F.lit(1))).alias("n"))
    found = reads.batch_range(asked, view.select("key")).groupBy("op_id").agg(F.lit(True).alias("__hit"))
    ranges = ranged.join(found, "op_id", "left").select("op_id", "op", F.coalesce("__hit", F.lit(False)).alias("ok"))
    writes = ops.filter(F.col("op").isin("set", "del", "update")).select("op_id", "op", F.lit(True).alias("ok"))
    return points.union(ranges).union(writes)


def apply_writes(ops: DataFrame, run: int, value_bytes: int) -> DataFrame:
    """The mutations of a pass: sets and updates write value_bytes bytes, dels a tombstone."""
    gone = F.col("op") == "del"
    value = F.when(~gone, F.repeat(F.lit("v"), value_bytes).cast("binary"))
    written = ops.filter(F.col("op").isin("set", "update", "del"))
    return written.select("key", value.alias("value"), gone.alias("tombstone"), F.lit(run).alias("run"), F.col("op_id").alias("seq"))


def without_merge(ops: DataFrame) -> DataFrame:
    """For maps that can't merge: an update becomes a get of its key and then a set, numbered op_id and step."""
    steps = F.when(F.col("op") == "update", F.array(F.lit("get"), F.lit("set"))).otherwise(F.array("op"))
    return ops.select("*", F.posexplode(steps).alias("step", "__op")).withColumn("op", F.col("__op")).drop("__op")


def run_passes(view: DataFrame, passes: list[DataFrame], merge: bool = True, value_bytes: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pass, op, attempted, succeeded) of all passes one after the other, and the live view after them.

    view: (key, value), both binary values as apply_writes makes them. A pass runs against what the passes before it
    left; each pass's writes are materialised, so a long sequence doesn't grow one plan.
    """
    reports = []
    rows = view.select("key", "value", F.lit(False).alias("tombstone"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("seq"))
    for i, ops in enumerate(passes):
        ops = ops if merge else without_merge(ops).drop("step")
        live = views.live(rows).select("key", "value")
        reports.append(materialise(op_counts(execute(ops, live)).withColumn("pass", F.lit(i))))
        rows = materialise(views.newest(rows.unionByName(apply_writes(ops, i + 1, value_bytes))))
    report = reports[0]
    for r in reports[1:]:
        report = report.union(r)
    return report.select("pass", "op", "attempted", "succeeded"), views.live(rows).select("key", "value")

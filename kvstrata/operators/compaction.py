"""Compaction planning over partition statistics, and the merges themselves.

A plan depends on counts and sizes only, so it is arithmetic over a small frame. Merges are the
views of views.py; which runs they rewrite is what differs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import views


@dataclass(frozen=True)
class Config:
    # Defaults of the cost model.
    max_pages: int = 20_400
    pages_accept: int = 5_000
    major_trigger: int = 8
    major_switch: int = 2
    estimate_safe: int = 14
    page_bytes: int = 4_096
    page_spare: int = 256
    pointer_bytes: int = 8
    sample_every: int = 8
    reject_share: int = 16
    reject_ratio: float = 0.1

    @property
    def run_bytes(self) -> int:
        return (self.page_bytes - self.page_spare) * self.max_pages


APPEND = 16
KINDS = ("major", "partial", "minor", "append", "reject")


def index_bytes(n_keys, runs, config: Config = Config()):
    """Estimated size of a sorted view over that many keys and (fractional) runs."""
    segments = F.floor(n_keys / F.lit(32))
    return (F.lit(config.pointer_bytes) * F.ceil(runs) + 16) * segments + n_keys


def new_data(delta: DataFrame, sample: bool = False, config: Config = Config()) -> DataFrame:
    """Per partition: new records and their bytes, exact or from every 8th record scaled up."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 4
    if sample:
        picked = F.pmod(F.xxhash64("key"), F.lit(config.sample_every)) == 0
        size = F.when(picked, size * config.sample_every).otherwise(0)
    return delta.groupBy("part_id").agg(F.count("*").alias("newnr"), F.sum(size).alias("newsz"), F.min("key").alias("new_first"))


def scores(stats: DataFrame, config: Config = Config()) -> DataFrame:
    """Per partition and first rewritten run i (0: all, R: none) the cost score; lower is better.

    stats: part_id, run, n_kv (records of the run), valid, totkv, totsz, newnr, newsz, and one row
    of run = R with n_kv 0. accu is the records in runs from i on.
    """
    w = Window.partitionBy("part_id").orderBy("run")
    up, down = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    f = stats.withColumn("accu", F.sum("n_kv").over(up)).withColumn("below", F.coalesce(F.sum("n_kv").over(down), F.lit(0))).withColumn("r", F.max("run").over(Window.partitionBy("part_id")))
    avg = F.floor(F.col("totsz") / F.col("totkv"))
    first = F.col("run") == 0
    f = f.withColumn("wx", F.col("newsz") + F.when(first, F.col("valid")).otherwise(F.col("accu")) * avg)
    f = f.withColumn("nrun1", F.col("wx") / F.lit(float(config.run_bytes)) + F.col("run"))
    keys = F.col("newnr") + F.when(first, F.col("valid")).otherwise(F.col("below") + F.col("accu"))
    f = f.withColumn("wy", index_bytes(keys, F.when(first, F.least("nrun1", F.lit(float(config.major_trigger)))).otherwise(F.col("nrun1")), config))
    f = f.withColumn("wa", (F.col("wx") + F.col("wy")) / F.col("newsz"))
    last = F.max(F.when(F.col("run") == F.col("r"), F.col("nrun1"))).over(Window.partitionBy("part_id"))
    f = f.withColumn("last", last).withColumn("bonus", F.col("last") - F.col("nrun1"))
    f = f.withColumn("bonus", F.col("bonus") + F.when(first & (F.col("last") > config.major_trigger), F.col("nrun1") - config.major_switch).otherwise(0) + F.when(F.col("run") == F.col("r"), 1).otherwise(0))
    return f.withColumn("score", (F.col("wa") + F.col("nrun1") * 0.75) / (F.col("bonus") + 4.0)).select("part_id", "run", "r", "wx", "wy", "nrun1", "wa", "bonus", "score")


def best_runs(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """Per partition the first run to rewrite: the least score among the runs allowed, else 0."""
    allowed = (F.col("run") == 0) | ((F.col("run") < config.major_trigger) & (F.col("nrun1") < config.estimate_safe))
    return scored.filter(allowed).groupBy("part_id", "r").agg(F.min_by("run", F.struct("score", "run")).alias("bestrun"))


def plan(partitions: DataFrame, best: DataFrame, config: Config = Config()) -> DataFrame:
    """(part_id, kind, bestrun, newsz, ratio) before rejections.

    partitions: part_id, n_runs, valid, newnr, newsz, totsz, overlap, is_last.
    """
    f = partitions.join(best.select("part_id", "bestrun"), "part_id", "left")
    append = ~F.col("overlap") & F.col("is_last") & (F.col("n_runs") > 1) & (F.col("newsz") > config.run_bytes)
    ratio = F.when(F.col("valid") == 0, F.col("newsz")).when(F.col("newnr") == 0, 0).when(append, F.col("newsz")).otherwise(F.col("newsz") / F.col("totsz"))
    kind = (
        F.when(F.col("valid") == 0, "major").when(F.col("newnr") == 0, "reject").when(append, "append").when(F.col("bestrun") == 0, "major").when(F.col("bestrun") < F.col("n_runs"), "partial").otherwise("minor")
    )
    run = F.when(F.col("valid") == 0, 0).when(F.col("newnr") == 0, config.major_trigger).when(append, APPEND).otherwise(F.col("bestrun"))
    return f.select("part_id", kind.alias("kind"), run.cast("int").alias("bestrun"), F.col("newsz").cast("long").alias("newsz"), ratio.cast("double").alias("ratio"))


def reject_small(planned: DataFrame, budget: int, config: Config = Config()) -> DataFrame:
    """Reject partitions from the smallest ratio on until one is too large, too dear or over budget.

    One row per partition of the store; the running sum is over that manifest-sized frame.
    """
    w = Window.orderBy("ratio", "part_id").rowsBetween(Window.unboundedPreceding, 0)
    stop = (F.col("newsz") > config.page_bytes * config.pages_accept) | (F.sum("newsz").over(w) > budget) | (F.col("ratio") > config.reject_ratio)
    f = planned.withColumn("__stop", F.max(stop).over(w))
    return f.withColumn("kind", F.when(F.col("__stop"), F.col("kind")).otherwise("reject")).withColumn("bestrun", F.when(F.col("__stop"), F.col("bestrun")).otherwise(config.major_trigger)).drop("__stop")


def minor(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """The delta becomes a run on top; nothing else is rewritten."""
    return rows.unionByName(views.newest(delta))


def partial(rows: DataFrame, delta: DataFrame, least_run: int) -> DataFrame:
    """Runs from least_run on and the delta become one run; tombstones stay, since older runs do."""
    merged = views.newest(rows.filter(F.col("run") >= least_run).unionByName(delta)).withColumn("run", F.lit(least_run))
    return rows.filter(F.col("run") < least_run).unionByName(merged)


def major(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """Everything becomes run 0 without tombstones."""
    return views.live(rows.unionByName(delta)).withColumn("run", F.lit(0))


def amplification(io: DataFrame) -> DataFrame:
    """Write and read amplification from bytes of log, tables, compaction reads and user data."""
    total = io.agg(*(F.sum(c).alias(c) for c in ("log_bytes", "table_bytes", "read_bytes", "user_bytes"))).select("*")
    user = F.nullif(F.col("user_bytes"), F.lit(0))
    return total.select(((F.col("log_bytes") + F.col("table_bytes")) / user).alias("write_amplification"), (F.col("read_bytes") / user).alias("read_amplification"))


def garbage(files: DataFrame, manifest: DataFrame, keep_versions: int) -> DataFrame:
    """Files that none of the newest versions refers to."""
    newest = manifest.agg(F.max("version").alias("__top"))
    used = manifest.crossJoin(F.broadcast(newest)).filter(F.col("version") > F.col("__top") - keep_versions).select("path").distinct()
    return files.join(used, "path", "left_anti")

"""Counters, bounded histories and the convergence test of measuring loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import globally_ranked

# Fixed values of the convergence test: values kept, and how close they must lie.
HISTORY, SHORT, LONG = 7, 0.004, 0.05


def bounded_history(rows: DataFrame, series: str, order: str, value: str, keep: int = HISTORY) -> DataFrame:
    """Minimum, maximum and mean of the last `keep` values, and the mean of all so far."""
    w = Window.partitionBy(series).orderBy(order)
    recent, all_ = w.rowsBetween(-(keep - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "*", F.min(value).over(recent).alias("recent_min"), F.max(value).over(recent).alias("recent_max"), F.avg(value).over(recent).alias("recent_avg"), F.avg(value).over(all_).alias("total_avg"), F.count("*").over(all_).alias("n_added")
    )


def converged(rows: DataFrame, series: str, order: str, value: str, keep: int = HISTORY) -> DataFrame:
    """Whether a loop may stop: the last three values agree, or the full history does, or it ran long."""
    w = Window.partitionBy(series).orderBy(order)
    f = bounded_history(rows, series, order, value, keep)
    near = F.col(value) * SHORT
    short = (F.abs(F.lag(value, 1).over(w) - F.col(value)) < near) & (F.abs(F.lag(value, 2).over(w) - F.col(value)) < near)
    long = (F.col("n_added") >= keep) & (F.abs(F.col("recent_max") - F.col("recent_min")) < F.col("recent_avg") * LONG)
    return f.withColumn("converged", F.coalesce(short, F.lit(False)) | long | (F.col("n_added") >= 2 * keep))


def added_counters(rows: DataFrame, group: list[str], counters: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(*(F.sum(c).alias(c) for c in counters))


def systematic_sample(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(step, value) of n rows at even steps of the sorted order, from the smallest to the largest."""
    ranked = globally_ranked(rows.select(F.col(value).alias("value")), "value")
    total = ranked.count()
    if not total or n < 1:
        return ranked.limit(0).select(F.lit(0).alias("step"), "value")
    steps = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("step"), F.floor(F.col("id") * (total - 1) / max(n - 1, 1)).alias("rank"))
    return ranked.join(F.broadcast(steps), "rank").select("step", "value")  # n rows


def bitmap(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """(group, word, bits): the numbers of each group as bits, 64 to a word; words without any aren't there."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(number), F.lit(64)).cast("int"))
    return rows.groupBy(*group, F.floor(F.col(number) / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def bitmap_summary(words: DataFrame, group: list[str], asked: int) -> DataFrame:
    """Per group how many bits are set, the first one, and whether `asked` is."""
    lowest = F.length(F.bin(F.col("bits").bitwiseAND(-F.col("bits")))) - 1
    here = F.when(F.col("word") == asked // 64, F.call_function("shiftrightunsigned", F.col("bits"), F.lit(asked % 64)).bitwiseAND(F.lit(1)) == 1)
    return words.groupBy(*group).agg(F.sum(F.bit_count("bits")).alias("n_set"), F.min(F.col("word") * 64 + lowest).alias("first"), F.coalesce(F.max(here), F.lit(False)).alias("has"))

"""Bloom filters as frames of words, built and tested with expressions.

A filter of n keys has bits_per_key * n bits and floor(ln 2 * bits_per_key) probes by double
hashing. A group is a run, or a run and page; words of a group are or-ed before the shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import rotl64
from ..session import materialise

BITS_PER_KEY = 10
#: Words of all filters that a test broadcasts, 64 MB; more are joined with the keys' bits.
BROADCAST_WORDS = 1 << 23


def probes(bits_per_key: int) -> int:
    return max(1, math.floor(math.log(2) * bits_per_key))


def places(key: Column, bits: Column, bits_per_key: int = BITS_PER_KEY) -> list[Column]:
    """The bit numbers that a key sets in a filter of that many bits."""
    h = F.xxhash64(key)
    first, step = F.pmod(h, bits), F.pmod(rotl64(h, 17), bits)
    return [F.pmod(first + F.lit(i) * step, bits) for i in range(probes(bits_per_key))]


def build(rows: DataFrame, group: list[str], key: str = "key", bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(group, bits, word, mask): one row per 64 bits that have any set."""
    sizes = rows.groupBy(*group).agg((F.count("*") * bits_per_key).alias("bits"))
    placed = rows.join(sizes, group).select(*group, "bits", F.explode(F.array(*places(F.col(key), F.col("bits"), bits_per_key))).alias("bit"))
    mask = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    return placed.groupBy(*group, "bits", F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(mask).alias("mask"))


def test(keys: DataFrame, filters: DataFrame, group: list[str], key: str = "key", bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(key, group, maybe) for distinct keys against every filter of their group columns.

    Keys without group columns are tested against all filters, however many: each key has a row a filter in the result.
    """
    filters, keyed = materialise(filters), set(group) <= set(keys.columns)
    keys = keys.select(key, *(group if keyed else [])).distinct()
    sizes = filters.groupBy(*group).agg(F.max("bits").alias("bits"))
    if (sizes.agg(F.sum(F.ceil(F.col("bits") / 64))).first()[0] or 0) <= BROADCAST_WORDS:
        every = sizes.select(*group, "bits", F.explode(F.expr("sequence(0L, (bits - 1) div 64)")).alias("word")).join(filters.drop("bits"), [*group, "word"], "left")
        words = F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))["mask"]
        packed = F.broadcast(every.groupBy(*group, "bits").agg(words.alias("words")))
        asked = keys.join(packed, group) if keyed else keys.crossJoin(packed)
        one = F.lit(1).cast("long")
        hits = [F.get("words", F.floor(bit / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", one, (bit % 64).cast("int"))) != 0 for bit in places(F.col(key), F.col("bits"), bits_per_key)]
        return asked.select(key, *group, reduce(Column.__and__, hits).alias("maybe"))
    asked = keys.join(sizes, group) if keyed else keys.crossJoin(F.broadcast(sizes))
    bits = asked.select(key, *group, F.explode(F.array(*places(F.col(key), F.col("bits"), bits_per_key))).alias("bit")).withColumn("word", F.floor(F.col("bit") / 64))
    hit = F.coalesce(F.expr("mask & shiftleft(1L, cast(bit % 64 as int))") != 0, F.lit(False))
    return bits.join(filters.drop("bits"), [*group, "word"], "left").groupBy(key, *group).agg(F.min(hit).alias("maybe"))


def quality(tested: DataFrame, truth: DataFrame, group: list[str], key: str = "key") -> DataFrame:
    """Per group the four counts and the share of absent keys that passed."""
    there = truth.select(key, *group).distinct().withColumn("there", F.lit(True))
    both = tested.join(there, [key, *group], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = both.groupBy(*group).agg(
        one(F.col("maybe") & F.col("there")).alias("tp"), one(~F.col("maybe") & ~F.col("there")).alias("tn"), one(F.col("maybe") & ~F.col("there")).alias("fp"), one(~F.col("maybe") & F.col("there")).alias("fn")
    )
    return counts.withColumn("fpr", F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0)))

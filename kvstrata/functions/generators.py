"""Key distributions as expressions of a row's number and a seed.

A number depends on the row's id and the seed alone, so a lost task makes the same rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import coprime_stride

#: Skew of the zipfian kinds.
THETA = 0.99


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hashed(c, seed: int = 0, salt: int = 0) -> Column:
    return F.xxhash64(_col(c), F.lit(seed).cast("long"), F.lit(salt))


def unit(c, seed: int = 0, salt: int = 0) -> Column:
    """A number in (0, 1)."""
    return (F.shiftrightunsigned(hashed(c, seed, salt), 11) + F.lit(0.5)) / F.lit(2.0**53)


def const(c, value: int, **_) -> Column:
    return F.lit(value).cast("long")


def rnd64(c, seed: int = 0, **_) -> Column:
    return hashed(c, seed)


def exponential(c, percentile: float, span: float, seed: int = 0, **_) -> Column:
    """So that `percentile` per cent of the numbers lie below `span`; unbounded."""
    rate = -math.log(1 - percentile / 100) / span
    return F.floor(-F.log(unit(c, seed)) / F.lit(rate)).cast("long")


def geometric(c, p: float, seed: int = 0, **_) -> Column:
    return F.floor(F.log(unit(c, seed)) / F.lit(math.log(1 - p))).cast("long")


def ascending(c, low: int, high: int, **_) -> Column:
    return F.lit(low) + F.pmod(_col(c), F.lit(high - low + 1))


def descending(c, low: int, high: int, **_) -> Column:
    return F.lit(high) - F.pmod(_col(c), F.lit(high - low + 1))


def _times_mod(c, factor: int, n: int) -> Column:
    """(c * factor) % n without overflow."""
    c = F.pmod(_col(c), F.lit(n))
    if n < 1 << 31:
        return F.pmod(c * F.lit(factor % n).cast("long"), F.lit(n).cast("long"))

    return F.pmod(c.cast("decimal(19,0)") * F.lit(factor % n).cast("decimal(18,0)"), F.lit(n).cast("decimal(19,0)")).cast("long")


def skipping(c, low: int, high: int, step: int, **_) -> Column:
    n = high - low + 1
    return F.lit(low) + _times_mod(c, step, n)


def shuffled(c, low: int, high: int, start: int = 0, **_) -> Column:
    """A permutation of [low, high]: a stride coprime to the size from any start."""
    n = high - low + 1
    return F.lit(low) + F.pmod(_times_mod(c, coprime_stride(n), n) + F.lit(start % n), F.lit(n))


def uniform(c, low: int, high: int, seed: int = 0, **_) -> Column:
    n = high - low + 1
    return F.lit(low) + F.least(F.floor(unit(c, seed) * F.lit(n)), F.lit(n - 1)).cast("long")


def zeta(n: int, theta: float = THETA) -> float:
    """sum of i**-theta for i in 1..n; beyond 10,000 terms by the Euler-Maclaurin formula."""
    head = min(n, 10_000)
    total = math.fsum(i**-theta for i in range(1, head + 1))
    if n > head:
        total += (n ** (1 - theta) - head ** (1 - theta)) / (1 - theta) + (n**-theta - head**-theta) / 2
    return total


def _zipf(c, n: int, seed: int) -> Column:
    """Rank 0 .. n-1, most frequent first, by the usual closed-form inverse."""
    if n < 2:
        return F.lit(0).cast("long")
    whole, two = zeta(n), zeta(2)
    power = 1 / (1 - THETA)
    slope = (1 - (2.0 / n) ** (1 - THETA)) / (1 - two / whole)
    u = unit(c, seed)
    rest = F.floor(F.lit(float(n)) * F.pow(F.lit(slope) * u - F.lit(slope) + F.lit(1.0), F.lit(power)))
    return F.when(u * whole < 1, 0).when(u * whole < 1 + 0.5**THETA, 1).otherwise(F.least(rest, F.lit(n - 1))).cast("long")


def zipfian(c, low: int, high: int, seed: int = 0, **_) -> Column:
    return F.lit(low) + _zipf(c, high - low + 1, seed)


def scattered_zipfian(c, low: int, high: int, seed: int = 0, **_) -> Column:
    """Zipfian ranks spread over the range by a coprime factor."""
    n = high - low + 1
    return F.lit(low) + _times_mod(_zipf(c, n, seed), coprime_stride(n), n)


def uniform_zipfian(c, low: int, high: int, hills: int, seed: int = 0, **_) -> Column:
    """Zipfian inside each of `hills` equal parts, the part being uniform."""
    size = (high - low + 1) // hills
    return F.lit(low) + _zipf(c, size, seed) + F.pmod(hashed(c, seed, 1), F.lit(hills)) * F.lit(size)


def zipfian_uniform(c, low: int, high: int, size: int, seed: int = 0, **_) -> Column:
    """Zipfian over groups of `size` keys, uniform inside a group."""
    groups = (high - low + 1) // size
    return F.lit(low) + _zipf(c, groups, seed) * F.lit(size) + F.pmod(hashed(c, seed, 1), F.lit(size))


GENERATORS = {
    "const": const,
    "rnd64": rnd64,
    "expo": exponential,
    "geo": geometric,
    "incs": ascending,
    "incu": ascending,
    "decs": descending,
    "decu": descending,
    "skips": skipping,
    "skipu": skipping,
    "shuffle": shuffled,
    "uniform": uniform,
    "zipfian": zipfian,
    "xzipfian": scattered_zipfian,
    "unizipf": uniform_zipfian,
    "zipfuni": zipfian_uniform,
}

#: Names of the arguments of a generator specification, in order.
ARGUMENTS = {
    "const": ("value",),
    "rnd64": (),
    "expo": ("percentile", "span"),
    "geo": ("p",),
    "skips": ("low", "high", "step"),
    "skipu": ("low", "high", "step"),
    "unizipf": ("low", "high", "hills"),
    "zipfuni": ("low", "high", "size"),
}


def parse(spec: str):
    """A function of (id column, seed) from a text such as 'uniform 0 999'."""
    kind, *given = spec.split()
    if kind not in GENERATORS:
        raise ValueError(f"unknown generator {kind!r}; known: {', '.join(GENERATORS)}")
    names = ARGUMENTS.get(kind, ("low", "high"))
    if len(given) != len(names):
        raise ValueError(f"{kind} takes {len(names)} arguments: {', '.join(names)}")
    numbers = {n: float(g) if "." in g or n in ("percentile", "span", "p") else int(g) for n, g in zip(names, given)}
    return lambda c, seed=0: GENERATORS[kind](c, seed=seed, **numbers)


def latest(ops: DataFrame, order: str, is_write: str, worker: str, reach: int, head: int = 0, seed: int = 0) -> DataFrame:
    """Writes take the next number of their worker; reads fall zipfian behind it, not below 0."""
    written = F.sum(F.col(is_write).cast("long")).over(Window.partitionBy(worker).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    now = F.lit(head) + written
    return ops.withColumn("number", F.when(F.col(is_write), now).otherwise(F.greatest(now - _zipf(F.col(order), reach, seed), F.lit(0))))

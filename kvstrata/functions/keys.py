"""Key codecs and scalar functions on keys, all as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def u64_key(c) -> Column:
    """Big-endian 8 bytes, so byte order is numeric order."""
    return F.unhex(F.lpad(F.hex(_col(c)), 16, "0"))


def u64_value(c) -> Column:
    """The unsigned number of an 8-byte key; null for other lengths."""
    return F.when(F.length(_col(c)) == 8, F.conv(F.hex(_col(c)), 16, 10).cast("decimal(20,0)"))


def hex_key(c, klen: int = 16) -> Column:
    """16 lower-case hex digits, filled on the left with '!' where klen is larger."""
    return F.concat(F.lit("!" * max(klen - 16, 0)), F.lpad(F.lower(F.hex(_col(c))), 16, "0"))


def hex_key_value(c) -> Column:
    """The number behind a hex key."""
    return F.conv(F.substring(_col(c), -16, 16), 16, 10).cast("decimal(20,0)")


def text_key(c) -> Column:
    """A line of a key file, without one white space character at its end."""
    return F.regexp_replace(_col(c), r"\s\z", "")


def key_hash(c) -> Column:
    return F.xxhash64(_col(c))


def key_tag(c) -> Column:
    """The low 8 bits of the key's hash."""
    return F.pmod(F.xxhash64(_col(c)), F.lit(256)).cast("int")


def compare(a, b) -> Column:
    """-1, 0 or 1 in key order."""
    a, b = _col(a), _col(b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def prefix(c, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def lcp(a, b) -> Column:
    """Length of the longest common prefix, found by doubling: 16 comparisons for keys below 64 KB."""
    a, b = _col(a), _col(b)
    most = F.least(F.length(a), F.length(b))

    def longer(have: Column, step: Column) -> Column:
        want = have + step
        return F.when((want <= most) & (F.substr(a, F.lit(1), want) == F.substr(b, F.lit(1), want)), want).otherwise(have)

    return F.aggregate(F.array(*(F.lit(1 << i) for i in range(16, -1, -1))), F.lit(0), longer)


def byte_at(c, i) -> Column:
    """The byte at a 0-based place; null beyond the end."""
    one = F.substr(_col(c), i + F.lit(1), F.lit(1))
    return F.when(F.length(one) == 1, F.conv(F.hex(one), 16, 10).cast("int"))


def highest_bit(c) -> Column:
    """The highest set bit of a byte as a mask; 0 for 0."""
    c = _col(c)
    out = F.lit(0)
    for i in range(8):
        out = F.when(c >= (1 << i), 1 << i).otherwise(out)
    return out


def discriminating_bit(a, b) -> Column:
    """struct(pos, mask): the highest bit that tells two keys apart.

    Where one key is a prefix of the other: the highest bit of the next byte (mask 0 if that byte
    is 0, which can't tell them apart); equal keys: mask 0.
    """
    a, b = _col(a), _col(b)
    at = lcp(a, b)
    x, y = byte_at(a, at), byte_at(b, at)
    return F.struct(at.alias("pos"), highest_bit(F.coalesce(x, F.lit(0)).bitwiseXOR(F.coalesce(y, F.lit(0)))).alias("mask"))


def hex_print(c) -> Column:
    """Bytes as lower-case hex pairs with blanks between."""
    return F.array_join(F.transform(F.filter(F.split(F.lower(F.hex(_col(c))), "(?<=\\G..)"), lambda x: x != ""), lambda x: x), " ")


def dec_print(c) -> Column:
    """Bytes as decimal numbers with blanks between."""
    pairs = F.filter(F.split(F.hex(_col(c)), "(?<=\\G..)"), lambda x: x != "")
    return F.array_join(F.transform(pairs, lambda x: F.conv(x, 16, 10)), " ")


def tokens(c, delimiters: str = r"\s+") -> Column:
    return F.filter(F.split(_col(c), delimiters), lambda x: x != "")


def rotl64(c, n: int) -> Column:
    c, n = _col(c).cast("long"), n % 64
    return F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, 64 - n)) if n else c


def rotr64(c, n: int) -> Column:
    return rotl64(c, -n % 64)


def reversed_bits(c) -> Column:
    """The 64 bits in reverse order."""
    digits = F.reverse(F.lpad(F.bin(_col(c).cast("long")), 64, "0"))
    high, low = (F.conv(F.substring(digits, at, 32), 2, 10).cast("long") for at in (1, 33))
    return F.shiftleft(high, 32).bitwiseOR(low)


def round_up(c, unit: int) -> Column:
    return F.floor((_col(c) + F.lit(unit - 1)) / F.lit(unit)).cast("long") * F.lit(unit)


def round_down(c, unit: int) -> Column:
    return _col(c) - F.pmod(_col(c), F.lit(unit))


def previous_power(c) -> Column:
    """The largest power of two that isn't above a positive number."""
    c = _col(c).cast("long")
    return F.when(c > 0, F.pow(F.lit(2.0), F.length(F.bin(c)) - 1).cast("long"))


def next_power(c) -> Column:
    """The smallest power of two that isn't below a positive number."""
    c = _col(c).cast("long")
    return F.when(previous_power(c) == c, c).otherwise(previous_power(c) * 2)


def bit_count(c) -> Column:
    return F.bit_count(_col(c))


def varint_bytes(c) -> Column:
    """Bytes of a number in groups of 7 bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(_col(c).cast("long"))) / F.lit(7))).cast("int")


def _byte(b: Column, i) -> Column:
    return F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("long")


def varint(c) -> Column:
    """A number from 0 on in groups of 7 bits, the low ones first; the high bit says that more follow."""
    v, n = _col(c).cast("long"), varint_bytes(c)

    def group(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", v, (i * 7).cast("int")).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(low + F.when(i < n - 1, 128).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), group), ""))


def varint_value(c) -> Column:
    """The number that a varint of up to 9 bytes stands for."""
    b = _col(c)
    add = lambda total, i: total + F.call_function("shiftleft", _byte(b, i).bitwiseAND(F.lit(127)), ((i - 1) * 7).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.lit(0).cast("long"), add)


#: The reflected polynomial of CRC-32C, and the number that key hashes start from.
CRC32C_POLYNOMIAL = 0x82F63B78
KEY_SEED = 0xDEADBEEF


def crc32c_table() -> list[int]:
    """The remainder of every byte."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (CRC32C_POLYNOMIAL if x & 1 else 0) for x in out]
    return out


def crc32c(c, seed: int = KEY_SEED) -> Column:
    """CRC-32C of a binary or text column from a seed, without a final inversion, one byte a step."""
    b, table = _col(c).cast("binary"), F.array(*map(F.lit, crc32c_table())).cast("array<bigint>")

    def step(crc: Column, i: Column) -> Column:
        at = crc.bitwiseXOR(_byte(b, i)).bitwiseAND(F.lit(255)).cast("int")
        return F.shiftright(crc, 8).bitwiseXOR(F.element_at(table, at + 1))

    steps = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(seed).cast("long"), step)


def record_bytes(key, value) -> Column:
    """Size of a record with both lengths in front as variable-length numbers."""
    k, v = F.length(_col(key)), F.coalesce(F.length(_col(value)), F.lit(0))
    return varint_bytes(k) + varint_bytes(v) + k + v


def gcd(a: int, b: int) -> int:
    return math.gcd(a, b)


def coprime_stride(n: int) -> int:
    """The first number from 0.618 n on that shares no divisor with n: its multiples visit all of [0, n)."""
    if n <= 2:
        return 1
    step = max(1, int(n * 0.618))
    while math.gcd(step, n) != 1:
        step += 1
    return step

"""Sources and sinks: key files, generated keys, runs, traces, and a registry by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys


def text_keys(spark: SparkSession, path: str) -> DataFrame:
    """One key a line, without one white space character at its end."""
    return spark.read.text(path).select(keys.text_key("value").cast("binary").alias("key"))


def generated_keys(spark: SparkSession, n: int, klen: int, fill: int, digits: list[tuple[int, int]]) -> DataFrame:
    """Keys of klen bytes `fill`; at listed (offset, count) places stand the digits of the row's number.

    The number is written in mixed radix, its least digit at the highest offset; a digit d is the byte fill + d.
    """
    place, radix = {}, 1
    for offset, count in sorted(digits, reverse=True):
        place[offset] = (radix, count)
        radix *= count
    byte = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))
    cells = [byte(F.lit(fill) + F.pmod(F.floor(F.col("id") / place[i][0]), F.lit(place[i][1]))) if i in place else F.lit(bytes([fill])) for i in range(klen)]
    return spark.range(n).select("id", F.concat(*cells).alias("key") if cells else F.lit(b"").alias("key"))


def generated_key_file(spark: SparkSession, path: str) -> DataFrame:
    """The same from a small text file: a line 'n klen fill', then lines 'offset count'."""
    lines = [r[0].split() for r in spark.read.text(path, wholetext=False).collect()]
    head, *rest = [line for line in lines if line]
    return generated_keys(spark, int(head[0]), int(head[1]), int(head[2]), [(int(a), int(b)) for a, b in rest])


def hex_keys(spark: SparkSession, n: int, klen: int = 16) -> DataFrame:
    return spark.range(n).select("id", keys.hex_key("id", klen).alias("key"))


def trace(spark: SparkSession, path: str) -> DataFrame:
    """(seq, page) from a text file with one page number a line, in line order."""
    rows = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return rows.select("seq", F.trim("value").cast("bigint").alias("page")).filter("page is not null")


def write_trace(df: DataFrame, path: str) -> None:
    df.orderBy("seq").select(F.col("page").cast("string").alias("value")).write.text(path)


def write_run(rows: DataFrame, path: str, start=None, end=None, drop_tombstones: bool = False) -> None:
    """Rows with start <= key < end as a sorted run."""
    if start is not None:
        rows = rows.filter(F.col("key") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("key") < F.lit(end))
    if drop_tombstones:
        rows = rows.filter(~F.col("tombstone"))
    rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)


def read_run(spark: SparkSession, path: str, run: int) -> DataFrame:
    return spark.read.parquet(path).withColumn("run", F.lit(run))


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A stack of runs, the first being the oldest."""
    out = read_run(spark, paths[0], 0)
    for i, path in enumerate(paths[1:], 1):
        out = out.unionByName(read_run(spark, path, i))
    return out


def dump(rows: DataFrame, path: str) -> None:
    """Keys as hex with value lengths and all flags, as CSV in key order."""
    flags = [c for c in rows.columns if c not in ("key", "value")]
    rows.orderBy("key").select(F.hex("key").alias("key"), F.length("value").alias("value_length"), *flags).write.csv(path, header=True)


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_kv"), F.countDistinct("key").alias("n_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))).alias("bytes"))


LOADERS = {"text": text_keys, "gen": generated_key_file, "trace": trace, "parquet": lambda spark, path: spark.read.parquet(path)}


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Load by kind, or by the path's ending."""
    kind = kind or {"txt": "text", "genkv": "gen", "trace": "trace"}.get(path.rsplit(".", 1)[-1], "parquet")
    if kind not in LOADERS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(LOADERS)}")
    return LOADERS[kind](spark, path)

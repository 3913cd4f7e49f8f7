"""Tables that experiment results are read into, and what is reported from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column layouts of the result files, which have no header.
DB_COLUMNS = (
    "sysname string, mem string, klen int, vlen int, thread int, nkv bigint, rgen string, verb string, nsec double, num_ops bigint, ops double, "
    "bio_write_io bigint, bio_read_io bigint, bio_write_bytes bigint, bio_read_bytes bigint, stats_write_io bigint, stats_read_io bigint, "
    "stats_write_sectors bigint, stats_read_sectors bigint, sctl_write_io bigint, sctl_read_io bigint, sctl_write_bytes bigint, sctl_read_bytes bigint"
)
YCSB_COLUMNS = "sysname string, workload string, mem string, klen int, vlen int, rgen string, nsec double, nops bigint, ops double, nset bigint, nupd bigint, nget bigint, nscan bigint"
LRU_COLUMNS = "filename string, cap bigint, miss_count bigint, hit_count bigint, tot_access bigint"
SECTOR_BYTES = 512


def read_results(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).csv(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Files of 'name = value' lines as (file, name, value)."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split("value", r"\s*=\s*", 2).alias("p"))
    return lines.filter(F.size("p") == 2).select("file", F.trim(F.col("p")[0]).alias("name"), F.trim(F.col("p")[1]).alias("value"))


def metadata_table(meta: DataFrame, names: list[str]) -> DataFrame:
    return meta.groupBy("file").pivot("name", names).agg(F.first("value"))


def io_per_query(sweep: DataFrame, meta: DataFrame, scale: int = 65_536) -> DataFrame:
    """Misses per operation for each trace and cache size; size also as a share of `scale` pages."""
    joined = sweep.join(meta, sweep["filename"] == meta["trace_file"])
    return joined.select("filename", "cap", (F.col("cap") / scale).alias("cache_size"), (F.col("miss_count") / F.col("num_ops")).alias("io_per_query"))


def throughput(results: DataFrame, memories: list[str], group: str = "sysname") -> DataFrame:
    """Thousand operations a second by system and memory limit."""
    return results.groupBy(group).pivot("mem", memories).agg(F.first(F.col("ops") / 1000))


def load_io(results: DataFrame, memories: list[str]) -> DataFrame:
    """TB read and written by system and memory limit."""
    return results.groupBy("sysname").pivot("mem", memories).agg(F.first((F.col("bio_read_bytes") + F.col("bio_write_bytes")) / 1e12))


def read_io(results: DataFrame, memories: list[str]) -> DataFrame:
    """KB read per operation by system and memory limit."""
    return results.groupBy("sysname").pivot("mem", memories).agg(F.first(F.col("bio_read_bytes") / F.col("num_ops") / 1024))


def ycsb_throughput(results: DataFrame, systems: list[str]) -> DataFrame:
    return results.groupBy("workload").pivot("sysname", systems).agg(F.first(F.col("ops") / 1000))


def block_io(events: DataFrame) -> DataFrame:
    """Number and bytes of reads and writes from block events (rw, bytes)."""
    return events.groupBy("rw").agg(F.count("*").alias("n_io"), F.sum("bytes").alias("total_bytes"))


def counter_deltas(samples: DataFrame, counters: list[str], wrap: int = 0) -> DataFrame:
    """End minus start of each counter by device; a negative difference gets `wrap` (2**32 for 32-bit counters)."""
    ends = samples.groupBy("device").agg(*(F.min_by(c, "at").alias(f"s_{c}") for c in counters), *(F.max_by(c, "at").alias(f"e_{c}") for c in counters))
    diff = lambda c: F.col(f"e_{c}") - F.col(f"s_{c}")
    return ends.select("device", *(F.when(diff(c) < 0, diff(c) + wrap).otherwise(diff(c)).alias(c) for c in counters))


def sector_bytes(deltas: DataFrame, sectors: list[str]) -> DataFrame:
    return deltas.select("*", *((F.col(c) * SECTOR_BYTES).alias(f"{c}_bytes") for c in sectors))


def ops_per_second(results: DataFrame) -> DataFrame:
    return results.withColumn("ops", F.col("num_ops") * 1e9 / F.col("nsec"))

"""Session helpers shared by the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or "/tmp/kvstrata-checkpoints"


def materialise(df: DataFrame) -> DataFrame:
    """Write to reliable shared storage and cut lineage; partitions keep their numbers."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def globally_ranked(df: DataFrame, *keys: str, name: str = "rank") -> DataFrame:
    """A dense 0-based rank by the keys, and the range partition (`pid`) of each row.

    Rows are range-partitioned and sorted, so no task sees more than its range; only one row
    count a partition goes through the driver.
    """
    spark = df.sparkSession
    ranged = materialise(df.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.withColumn("pid", F.spark_partition_id()).withColumn("__within", within)
    offset, offsets = 0, []
    for pid, n in sorted((r["pid"], r["count"]) for r in placed.groupBy("pid").count().collect()):
        offsets += [offset] * (pid + 1 - len(offsets))
        offset += n
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__within")
    table = F.array(*map(F.lit, offsets)).cast("array<bigint>")
    return placed.withColumn(name, F.element_at(table, F.col("pid") + 1) + F.col("__within")).drop("__within")

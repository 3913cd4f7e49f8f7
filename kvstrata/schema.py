"""Frames that the engine works on.

A mutation is a versioned key: a higher run is newer, seq orders mutations inside a run, and a
tombstone hides what is older. Keys are bytes compared as unsigned bytes, then by length, which is
how Spark orders BINARY.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MUTATIONS = "key binary, value binary, tombstone boolean, run int, seq bigint"
MANIFEST = "version bigint, part_id int, anchor binary, run int, path string, n_kv bigint, bytes bigint, first_key binary, last_key binary"
OPS = "op_id bigint, worker int, op string, key binary, value binary, n int"
TRACE = "seq bigint, page bigint"

# Fixed values of the data model.
MAX_RUNS = 16
MAX_KEY_AND_VALUE = 65_500
PAGE_BYTES = 4096


def mutations(df: DataFrame, key, value, tombstone, run, seq) -> DataFrame:
    """Name the columns of a frame by their role; all other columns are dropped."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(key).alias("key"), as_col(value).alias("value"), as_col(tombstone).alias("tombstone"), as_col(run).alias("run"), as_col(seq).alias("seq"))


def checked(df: DataFrame) -> DataFrame:
    """The rows, failing at run time on a null key or one too large for a record."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    ok = F.col("key").isNotNull() & (size <= MAX_KEY_AND_VALUE)
    return df.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit("key is null or record is over the size limit")).cast(df.schema["key"].dataType)))

"""What the text operators share: column selection, bounded Arrow slices, exact word splitting.

Words are maximal runs of characters other than space and \\t \\n \\v \\f \\r. Arrow's ASCII
splitter uses exactly that set, so splitting stays in C++ and words are bytes-exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 2 << 20

#: Rows of a few numbers that may be broadcast: about 24 MB.
BROADCAST_ROWS = 1_000_000


def col(name: str):
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text), so other columns can't clash; a null text is an empty one."""
    return df.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or "/tmp/kvstrata-checkpoints"


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its rows (counted by the caller) are BROADCAST_ROWS at most; else Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """Numbers of which the i-th is dealt to partition i by repartition(n, column of them): hashing alone fills some partitions twice."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        rows = spark.range(size).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("p")).agg(F.min("label").alias("label"))
        found = {r["p"]: r["label"] for r in rows.collect()}
        size *= 4
    return [found[i] for i in range(n)]


def dealt_evenly(spark: SparkSession, number, n: int):
    """A column by which repartition(n, it) puts number modulo n into partition number modulo n."""
    return F.element_at(F.array(*map(F.lit, even_labels(spark, n))), F.pmod(number, F.lit(n)).cast("int") + 1)


def cut(df: DataFrame) -> DataFrame:
    """Materialise to reliable shared storage and cut lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def plain(array) -> pa.Array:
    """A string array with 32-bit offsets and no nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.type != pa.string():
        array = array.cast(pa.string())
    return pc.fill_null(array, "") if array.null_count else array


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches at about `most` bytes of column `text`."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // most
        at = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *at.tolist()], [*at.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(plain(text))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        flat = flat.filter(full)
        at = np.concatenate([[0], np.cumsum(keep)])[at]
    return flat, at


def coded_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers, the distinct words they stand for, and where each text begins."""
    flat, at = split_words(text)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, at


def byte_data(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and where each text begins in them."""
    text = text if text.type == pa.binary() else plain(text)
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def sums_at(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values in [at[i], at[i+1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def ranks_within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each group of so many."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def run_max(values: np.ndarray, width: int) -> np.ndarray:
    """Maximum over every `width` consecutive values; the result is width-1 shorter."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.maximum(out[:-step], out[step:])
        have += step
    return out


def run_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out

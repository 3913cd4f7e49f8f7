"""Quality classifier by importance resampling over hashed n-gram models.

Two generative models, one of target text and one of the raw corpus, give each hashed word and
word pair a probability. A document's log weight is the summed log ratio of its features; divided by
their number, so that length neither helps nor harms, it is its mean. The k documents with the
largest mean / temperature plus Gumbel noise are a draw of k documents without replacement with
probabilities in proportion to exp(mean / temperature). The noise is a keyed hash of seed and document,
so a run can be repeated, and another seed draws others.

The raw model counts every feature of every document. The target model is fitted on labelled
rows of target text, at most `target_rows` of them (a documented bound; they are picked by keyed hash),
half of which are held out: the share `keep_clean` of the held-out rows reaches a certain mean.
Unless it is given, k is the number of documents that reach that mean. The temperature is
small against the distance of junk from it, so the draw decides among documents near the edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKET_BITS = 14
TARGET_ROWS = 20_000
SEED = 42
#: Added to every bucket's count, in both models.
SMOOTHING = 1.0
#: Of the draw: a row is exp(mean / TEMPERATURE) times as likely to be drawn as one with mean 0.
TEMPERATURE = 0.02
#: Width of the last step of the search for the k-th largest key.
LAST_ROWS = 10_000

_PIECE = re.compile(r"\w+|[^\w\s]+")
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def features(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of all texts, and where each text's begin.

    Words are lower-cased runs of word characters or of marks. Pairs don't cross texts.
    """
    codes, vocabulary, at = C.coded_words(text)
    split = [_PIECE.findall(w.lower()) for w in vocabulary.to_pylist()]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(p.encode(), SEED) for w in split for p in w), _U, int(sizes.sum()))
    starts, per_word = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.concatenate([[0], np.cumsum(per_word)])
    words = hashes[np.repeat(starts[codes] - ends[:-1], per_word) + np.arange(ends[-1])]
    at = ends[at]
    pairs = _mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]) if len(words) else words
    # Put a text's words and pairs side by side: word i, then pair (i, i + 1) but for the last.
    both = np.empty(2 * len(words), _U)
    both[0::2] = _mix(words)
    both[1:-1:2] = pairs
    keep = np.ones(len(both), bool)
    filled = at[1:][np.diff(at) > 0]
    keep[2 * filled - 1] = False
    return (both[keep] >> _U(64 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(keep)])[2 * at]


def bucket_counts(df: DataFrame, group: str | None, text_col: str = "text", bits: int = BUCKET_BITS) -> DataFrame:
    """(class, bucket, n) over all rows; a partition sends each bucket once."""
    rows = df.select((C.col(group) if group else F.lit(0)).cast("int").alias("class"), F.coalesce(C.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in C.slices(batches):
            buckets, at = features(batch.column("text"), bits)
            owner = np.repeat(batch.column("class").to_numpy(), np.diff(at))
            for c in np.unique(owner).tolist():
                totals[c] = totals.get(c, 0) + np.bincount(buckets[owner == c], minlength=1 << bits)
        for c, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), c, np.int32)), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["class", "bucket", "n"])

    return rows.mapInArrow(run, "class int, bucket int, n bigint").groupBy("class", "bucket").agg(F.sum("n").alias("n"))


def log_model(rows: list, bits: int) -> np.ndarray:
    counts = np.full(1 << bits, SMOOTHING)
    for r in rows:
        counts[r["bucket"]] += r["n"]
    return np.log(counts / counts.sum())


def gumbel(h: np.ndarray) -> np.ndarray:
    """Gumbel noise from 64-bit hashes."""
    return -np.log(-np.log(((h.view(np.uint64) >> _U(11)).astype(np.float64) + 0.5) / 2.0**53))


def _scores(batch: pa.RecordBatch, table: np.ndarray, bits: int, temperature: float) -> list[np.ndarray]:
    """n_features, log_weight and gumbel_key of each row of (text, h); a row's numbers don't depend on others."""
    buckets, at = features(batch.column("text"), bits)
    count = np.diff(at)
    total = np.add.reduceat(np.append(table[buckets], 0.0), at[:-1])
    total[count == 0] = 0
    return [count, total, total / np.maximum(count, 1) / temperature + gumbel(batch.column("h").to_numpy())]


def scored(df: DataFrame, ratio, bits: int, temperature: float) -> DataFrame:
    """doc_id, h, n_features, log_weight and gumbel_key from (doc_id, text, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *map(pa.array, _scores(batch, ratio.value, bits, temperature))], names=["doc_id", "h", "n_features", "log_weight", "gumbel_key"])

    return df.select("doc_id", "text", "h").mapInArrow(run, f"doc_id {C.id_type(df, 'doc_id')}, h bigint, n_features bigint, log_weight double, gumbel_key double")


def _labelled(labels: DataFrame, rows: int, id_col: str) -> DataFrame:
    """(label_id, train) of target rows: `rows` at most, picked and halved by keyed hash."""
    one = labels.select(C.col(id_col).alias("label_id"), C.col("quality").cast("int").alias("quality")).filter("label_id is not null and quality in (0, 1)")
    one = one.groupBy("label_id").agg(F.min("quality").alias("quality")).filter("quality = 1").withColumn("h", F.xxhash64(F.lit(SEED), "label_id"))
    return one.orderBy("h", "label_id").limit(rows).select("label_id", (F.shiftrightunsigned("h", 7).bitwiseAND(F.lit(1)) == 0).alias("train"))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting ever narrower ranges; at most LAST_ROWS values are fetched."""
    if k <= 0:
        return float("inf")
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        within = rows.filter(F.col(column).between(low, high))
        step = (high - low) / 4096
        if step <= 0 or low + step == low:
            return low
        part = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(4095)).alias("part")
        found = sorted(within.groupBy(part).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["part"])
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high = r["lo"], r["hi"]
        if r["n"] <= LAST_ROWS:
            values = sorted((v[0] for v in within.filter(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - above - 1]


def _hashed_rows(df: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    return C.id_text(df, id_col, text_col).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))


def _drawn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, bits: int, target_rows: int, keep_clean: float, temperature: float, k: int | None, seed: int) -> tuple:
    """The broadcast log ratios, the scored rows and the gumbel_key from which rows are selected."""
    sc = df.sparkSession.sparkContext
    sample = C.cut(_labelled(labels, target_rows, id_col))
    train = F.broadcast(sample.filter("train").select("label_id"))  # target_rows at most
    marked = C.id_text(df, id_col, text_col).join(train, F.col("doc_id") == F.col("label_id"), "left").withColumn("target", F.col("label_id").isNotNull())
    counts = bucket_counts(marked, "target", "text", bits).collect()  # two rows a bucket at most
    target = [r for r in counts if r["class"] == 1]
    ratio = sc.broadcast(log_model(target, bits) - log_model(counts, bits) if target else np.zeros(1 << bits))
    rows = C.cut(scored(_hashed_rows(df, id_col, text_col, seed), ratio, bits, temperature))
    mean = F.col("log_weight") / F.greatest("n_features", F.lit(1))
    if k is None:
        held = rows.join(F.broadcast(sample.filter("not train").select("label_id")), F.col("doc_id") == F.col("label_id"), "left_semi")
        floor = held.select(F.percentile(mean, 1 - keep_clean)).first()[0]
        k = rows.filter(F.lit(True) if floor is None else mean >= F.lit(floor)).count()
    total = rows.count()
    return ratio, rows, kth_largest(rows, "gumbel_key", min(k, total)) if total else 0.0


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BUCKET_BITS, target_rows: int = TARGET_ROWS, keep_clean: float = 0.999, temperature: float = TEMPERATURE, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, h, n_features, log_weight, gumbel_key, selected for every row.

    labels: (id_col, quality), 1 being target text. k: how many rows to draw; by default as many as
    reach the mean log weight that the share keep_clean of held-out target rows reaches.
    Defined cases: a null or wordless text has no features and weight 0; null ids are rows like
    others; equal rows draw equal noise, so where they tie at the k-th place all of them are
    selected; labels for unknown ids are ignored; without labelled target rows every weight is 0 and
    all rows are selected unless k says otherwise; an empty table gives no rows; other columns are ignored.
    """
    _, rows, least = _drawn(df, labels, id_col, text_col, bits, target_rows, keep_clean, temperature, k, seed)
    return rows.withColumn("selected", F.col("gumbel_key") >= F.lit(least))


def selected_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BUCKET_BITS, target_rows: int = TARGET_ROWS, keep_clean: float = 0.999, temperature: float = TEMPERATURE, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The selected rows with all their columns: a last pass scores the texts again and drops rows, so no text is shuffled."""
    ratio, _, least = _drawn(df, labels, id_col, text_col, bits, target_rows, keep_clean, temperature, k, seed)
    n, where = len(df.columns), df.columns.index(text_col)
    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), C.col(id_col), F.coalesce(C.col(text_col), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(where), batch.column(n), pa.array(np.arange(batch.num_rows))], names=["text", "h", "at"])
            keep = [np.zeros(0, np.int64)]
            for part in C.slices(iter([texts])):
                keep.append(part.column("at").to_numpy()[_scores(part, ratio.value, bits, temperature)[2] >= least])
            out = batch.take(pa.array(np.concatenate(keep)))
            yield pa.RecordBatch.from_arrays([out.column(i) for i in range(n)], names=batch.schema.names[:n])

    return rows.mapInArrow(run, df.schema)

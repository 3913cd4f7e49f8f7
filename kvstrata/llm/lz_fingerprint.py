"""Lempel-Ziv phrase fingerprints and their likeness.

LZ78 cuts a text into phrases, each one longer by a character than a phrase seen before. The set
of phrases is hashed and kept as a one-permutation minimum-hash signature: the hash range is cut
into BINS parts, and each part keeps 16 bits drawn from its smallest hash. The share of equal
parts among those filled in either signature estimates the Jaccard likeness of the phrase sets.

Phrases are looked up as strings: no phrase is longer than about the square root of twice the text, so a
text of n equal characters takes n ** 1.5 byte steps at worst, and prose a few for each character.

Each document is compared with its neighbour in id order, so rows are dealt into id ranges of
about equal size and sorted there; only the first document of a range is also sent to the range
before it. One shuffle of the texts in all.

Defined cases: a null text is empty; the empty text has an empty signature, alike (1.0) to another
empty one and unlike (0.0) anything else; a null id sorts first; rows that share an id are ordered
by text; a single row is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BINS = 128
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 4096)
        for name, base in (("_POWERS", _BASE), ("_INVERSE", pow(_BASE, -1, 1 << 64))):
            globals()[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return _POWERS, _INVERSE


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def parse(text: str, phrases: dict[str, None], open_phrase: str = "") -> str:
    """Go on with an LZ78 parse: adds the phrases of `text`, returns the phrase left open."""
    phrase = open_phrase
    for c in text:
        longer = phrase + c
        if longer in phrases:
            phrase = longer
        else:
            phrases[longer] = None
            phrase = ""
    return phrase


def signature(text: str, phrases: dict[str, None]) -> np.ndarray:
    """The phrases follow one another in the text, so prefix sums hash all of them at once."""
    out = np.zeros(BINS, np.uint16)
    if not phrases:
        return out
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    n = int(ends[-1])
    powers, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    units = np.frombuffer(text.encode("utf-32-le"), np.uint32)[:n].astype(np.uint64) + np.uint64(1)
    np.cumsum(units * powers[:n], out=sums[1:])
    starts = np.concatenate([[0], ends[:-1]])
    hashes = np.sort(mix((sums[ends] - sums[starts]) * inverse[starts]))
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    bins = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = (mix(hashes[first]) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = int(((a > 0) | (b > 0)).sum())
    return float(((a == b) & (a > 0)).sum() / filled) if filled else 1.0


class Parsed:
    """A text with its signature and the state of its parse where its last quarter begins."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.tail = len(text) // 4
        self.head = text[: len(text) - self.tail]
        phrases: dict[str, None] = {}
        self.open = parse(self.head, phrases)
        self.phrases = dict(phrases) if self.tail else phrases
        parse(text[len(self.head) :], phrases, self.open)
        self.print = signature(text, phrases)

    def against(self, following: "Parsed") -> tuple:
        edited = self.head + following.text[: self.tail]
        parse(edited[len(self.head) :], self.phrases, self.open)
        other = signature(edited, self.phrases)
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256(edited.encode()).hexdigest(),
            self.print.tobytes().hex(),
            other.tobytes().hex(),
            likeness(self.print, other),
            likeness(self.print, following.print),
        )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in C.slices(batches):
        for i, row in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist())):
            yield *row, batch.column("text")[i].as_py()


_INTEGERS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def lz_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges_per_partition: int = 3) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike they and the next one's are.

    The edited text has its last quarter replaced by the start of the next document in id order
    (after the last one: the first). Ids must be integers: TypeError otherwise.
    """
    spark = df.sparkSession
    kind = C.id_type(df, id_col)
    if kind not in _INTEGERS:
        raise TypeError(f"ids must be integers, not {kind}")
    rows = C.id_text(df, id_col, text_col)
    n = C.parts(spark)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    k = n * ranges_per_partition
    cuts = df.select(F.percentile_approx(C.col(id_col).cast("long"), [i / k for i in range(1, k)], 100 * k).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>") if cuts else None
    if cuts:
        # Binary search: how many cuts lie below the id.
        steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

        def halve(s, _):
            mid = ((s["lo"] + s["hi"]) / 2).cast("int")
            below = (s["lo"] < s["hi"]) & (F.element_at(bounds, F.least(mid + 1, F.lit(len(cuts)))) < order)
            return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

        bucket = F.aggregate(steps, start, halve)["lo"]
    else:
        bucket = F.lit(0)
    ids = df.select(C.col(id_col).alias("doc_id"))
    first = {r["b"]: r["m"] for r in ids.groupBy(bucket.alias("b")).agg(F.min(order).alias("m")).collect()}
    full = sorted(first)
    size = len(cuts) + 1
    before = {b: full[i - 1] for i, b in enumerate(full)}
    firsts = F.array(*(F.lit(first.get(b)).cast("long") for b in range(size)))
    ahead_of = F.array(*(F.lit(before.get(b)).cast("int") for b in range(size)))
    sent = rows.withColumn("b", bucket)
    to = F.array(
        F.struct(F.col("b").alias("bucket"), F.lit(False).alias("ahead")),
        F.when(order == F.element_at(firsts, F.col("b") + 1), F.struct(F.element_at(ahead_of, F.col("b") + 1).alias("bucket"), F.lit(True).alias("ahead"))),
    )
    sent = sent.select("doc_id", "text", F.explode(F.filter(to, lambda x: x.isNotNull())).alias("t")).select("t.bucket", "t.ahead", "doc_id", "text")
    dealt = sent.repartition(n, C.dealt_evenly(spark, F.col("bucket"), n)).sortWithinPartitions("bucket", "ahead", order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None  # bucket, Parsed
        done = False  # the bucket's last document has met its next
        for bucket, ahead, doc_id, text in _rows(batches):
            if ahead and (done or last is None or last[0] != bucket):
                continue
            now = Parsed(doc_id, text)
            if last is not None and last[0] == bucket and not (done and ahead):
                out.append(last[1].against(now))
            done = ahead
            last = (bucket, now)
            if len(out) >= 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        types = [_INTEGERS[kind], pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=NAMES)

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""The sorted view's flags and statistics as frames: segments, suffix counts, anchors, key ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..session import globally_ranked
from . import reads, views

#: Slots of a segment of the slot form; keys and discriminating bits that close one of the bit form.
SLOTS, SEGMENT_KEYS, SEGMENT_BITS = 32, 64, 32


def sorted_view(rows: DataFrame) -> DataFrame:
    """Every version with stale, tombstone and tail (the oldest version of its key)."""
    own = F.struct("run", "seq")
    ends = rows.groupBy(F.col("key").alias("__k")).agg(F.max(own).alias("__top"), F.min(own).alias("__low"))
    joined = rows.join(ends, F.col("key").eqNullSafe(F.col("__k")))
    return joined.withColumn("stale", own < F.col("__top")).withColumn("tail", own == F.col("__low")).drop("__k", "__top", "__low")


def _assigned(rows: DataFrame, close) -> DataFrame:
    """Segment numbers of distinct keys in key order; every range partition begins a segment of its own."""
    kind = rows.schema["key"].dataType.simpleString()
    extra = [c for c in rows.columns if c != "key"]
    ranked = globally_ranked(rows, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = close()
        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column("pid")[0].as_py()
            got = list(map(state, *(batch.column(c).to_pylist() for c in ("key", *extra))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([pid] * batch.num_rows, pa.int32()), pa.array(got, pa.int64())], names=["key", "pid", "segment"])

    return ranked.mapInArrow(run, f"key {kind}, pid int, segment bigint")


def slot_segments(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(key, pid, segment): all versions of a key share a segment, one that would split opens the next."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).select("key", "n")

    def close():
        segment, used = 0, 0

        def place(_, n: int) -> int:
            nonlocal segment, used
            if used and used + n > slots:
                segment, used = segment + 1, 0
            used += n
            return segment

        return place

    return _assigned(counts, close)


def bit_segments(rows: DataFrame, most_keys: int = SEGMENT_KEYS, most_bits: int = SEGMENT_BITS) -> DataFrame:
    """(key, pid, segment): a segment closes at its limit of keys, or of bits that tell its keys apart."""

    def close():
        segment, n, last = 0, 0, None
        bits: set[tuple[int, int]] = set()

        def place(key: bytes) -> int:
            nonlocal segment, n, last
            if n and (n >= most_keys or len(bits) >= most_bits):
                segment, n, last = segment + 1, 0, None
                bits.clear()
            if last is not None:
                at, mask = dbit(last, key)
                if mask:
                    bits.add((at, mask))
            n, last = n + 1, key
            return segment

        return place

    return _assigned(rows.select(F.col("key").cast("binary").alias("key")).distinct(), close)


def dbit(a: bytes, b: bytes) -> tuple[int, int]:
    """(byte place, mask) of the highest bit that tells two keys apart; mask 0 if they can't be."""
    n = min(len(a), len(b))
    at = next((i for i in range(n) if a[i] != b[i]), n)
    x = (a[at] if at < len(a) else 0) ^ (b[at] if at < len(b) else 0)
    return at, 1 << (x.bit_length() - 1) if x else 0


def segment_histogram(ranked: DataFrame, slots: int = SLOTS) -> DataFrame:
    """How many segments of `slots` neighbouring keys hold how many keys."""
    sizes = ranked.groupBy(F.floor(F.col("rank") / slots).alias("segment")).agg(F.count("*").alias("n_keys"))
    return sizes.groupBy("n_keys").agg(F.count("*").alias("n_segments"))


def run_statistics(rows: DataFrame) -> DataFrame:
    """Per run: records, bytes and how many are newest or stale, tombstones apart."""
    flagged = views.all_versions(rows)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return flagged.groupBy("run").agg(
        F.count("*").alias("n_kv"),
        F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))).alias("bytes"),
        one(~F.col("stale")).alias("valid_kv"),
        one(F.col("stale")).alias("stale_kv"),
        one(~F.col("stale") & F.col("tombstone")).alias("valid_ts"),
        one(F.col("stale") & F.col("tombstone")).alias("stale_ts"),
    )


def _upward():
    """Runs from this one upward. One row per run, and there are at most 16, so one task holds them all."""
    return Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, 0)


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """The statistics of each run with those of all newer runs added up."""
    stats = run_statistics(rows)
    return stats.select("run", *(F.sum(c).over(_upward()).alias(c) for c in stats.columns if c != "run"))


def newest_per_suffix(rows: DataFrame) -> DataFrame:
    """uniqx: keys whose newest version lies in run i or a newer one."""
    here = views.newest(rows).groupBy("run").agg(F.count("*").alias("n"))
    runs = rows.select("run").distinct().join(here, "run", "left")
    return runs.select("run", F.sum(F.coalesce("n", F.lit(0))).over(_upward()).alias("uniqx"))


def with_previous(rows: DataFrame, name: str = "key") -> DataFrame:
    """The rows in key order with `previous`, the key before, across partitions too."""
    ranked = globally_ranked(rows, name)
    lasts = {r["pid"]: r["k"] for r in ranked.groupBy("pid").agg(F.max(name).alias("k")).collect()}
    full = sorted(lasts)
    kind = rows.schema[name].dataType
    before = {p: lasts[full[i - 1]] if i else None for i, p in enumerate(full)}
    size = max(full, default=0) + 1
    carried = F.element_at(F.array(*(F.lit(before.get(p)).cast(kind) for p in range(size))), F.col("pid") + 1)
    return ranked.withColumn("previous", F.coalesce(F.lag(name).over(Window.partitionBy("pid").orderBy("rank")), carried)).drop("pid")


def anchors(rows: DataFrame, name: str = "key") -> DataFrame:
    """The shortest prefix of each key that sorts after the key before: common prefix plus one byte."""
    ordered = with_previous(rows, name)
    size = F.when(F.col("previous").isNull(), F.lit(0)).otherwise(F.least(K.lcp("previous", name) + 1, F.length(name)))
    return ordered.withColumn("anchor", F.substr(F.col(name), F.lit(1), size)).drop("previous")


def compressed_keys(rows: DataFrame, name: str = "key") -> DataFrame:
    """(rank, lcp, suffix): each key as what it shares with the one before and the rest."""
    ordered = with_previous(rows, name)
    shared = F.when(F.col("previous").isNull(), F.lit(0)).otherwise(K.lcp("previous", name))
    return ordered.withColumn("lcp", shared).withColumn("suffix", F.substr(F.col(name), F.col("lcp") + 1)).drop("previous")


def full_index(rows: DataFrame) -> DataFrame:
    """Newest version of every key as (key, run, idx): idx is its place in its run."""
    placed = globally_ranked(rows, "run", "key", name="place").drop("pid")
    first = placed.groupBy("run").agg(F.min("place").alias("__first"))
    return views.newest(placed.join(F.broadcast(first), "run")).select("key", "run", (F.col("place") - F.col("__first")).alias("idx"), "tombstone")


def key_range(rows: DataFrame) -> DataFrame:
    """(part_id, first_key, last_key): all that a partition without an index keeps."""
    return rows.groupBy("part_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def index_bits_per_key(index_bytes, n_kv):
    return index_bytes * 8 / n_kv


def discriminating_bits(segmented: DataFrame) -> DataFrame:
    """(pid, segment, n_keys, n_bits): bits needed to tell the keys of every segment apart."""
    before = F.lag("key").over(Window.partitionBy("pid", "segment").orderBy("key"))
    pairs = segmented.withColumn("__before", before)
    bits = pairs.filter("__before is not null").withColumn("d", K.discriminating_bit("__before", "key"))
    masks = bits.groupBy("pid", "segment", F.col("d.pos").alias("pos")).agg(F.bit_or(F.col("d.mask")).alias("mask"))
    total = masks.groupBy("pid", "segment").agg(F.sum(F.bit_count("mask")).alias("n_bits"))
    sizes = segmented.groupBy("pid", "segment").agg(F.count("*").alias("n_keys"))
    return sizes.join(total, ["pid", "segment"], "left").fillna(0, ["n_bits"])


class PartialKeys:
    """The bits that tell one segment's sorted keys apart, and searches by them."""

    def __init__(self, keys: list[bytes]):
        self.keys = keys
        masks: dict[int, int] = {}
        for a, b in zip(keys, keys[1:]):
            at, mask = dbit(a, b)
            if not mask and a != b:
                raise ValueError("a key followed by a zero byte can't be told from its prefix")
            masks[at] = masks.get(at, 0) | mask
        self.places = [(at, 1 << i) for at in sorted(masks) for i in range(7, -1, -1) if masks[at] >> i & 1]
        self.codes = np.array([self.extract(k) for k in keys], np.uint64)

    def extract(self, key: bytes) -> int:
        """The chosen bits of a key, highest first; bytes beyond its end count as 0."""
        out = 0
        for at, mask in self.places:
            out = out << 1 | (at < len(key) and key[at] & mask != 0)
        return out

    def search(self, key: bytes) -> int:
        """First place whose bits aren't below the key's; the true bound needs correct()."""
        return int(np.searchsorted(self.codes, np.uint64(self.extract(key))))

    def match(self, key: bytes) -> int | None:
        """Place of the key, found by one code comparison and one key comparison."""
        at = self.search(key)
        return at if at < len(self.keys) and self.keys[at] == key else None

    def correct(self, key: bytes) -> int:
        """The true lower bound: one key comparison at the guess, then neighbours that share the decisive bits."""
        guess = min(self.search(key), len(self.keys) - 1)
        at, mask = dbit(self.keys[guess], key)
        if not mask and self.keys[guess] == key:
            return guess
        # Keys that agree with the guess on all chosen bits before the first differing one form one run.
        shift = sum(1 for p in self.places if (p[0], -p[1]) > (at, -mask))
        group = self.codes >> np.uint64(shift) if shift < 64 else np.zeros_like(self.codes)
        run = np.flatnonzero(group == group[guess])
        return int(run[0]) if key < self.keys[guess] else int(run[-1]) + 1


def partial_key_search(segmented: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, n_below, matched) for probes (key): how many of all keys lie below, found by partial keys.

    segmented: from bit_segments. A probe goes to the segment whose first key is the last one at or
    before it; there its chosen bits are compared with the segment's codes, and one key comparison
    corrects the place.
    """
    ranked = globally_ranked(segmented.select("key", F.col("pid").alias("p"), "segment"), "key").drop("pid")
    parts = ranked.groupBy("p", "segment").agg(F.min("key").alias("anchor"), F.min("rank").alias("part_id"))
    located = reads.locate(probes.select("key").distinct(), parts.select("part_id", "anchor")).select(F.coalesce("part_id", F.lit(0)).cast("long").alias("base"), "key", F.lit(True).alias("asked"))
    stored = ranked.join(parts, ["p", "segment"]).select(F.col("part_id").alias("base"), "key", F.lit(False).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, own, codes = None, [], None
        for batch in batches:
            out = []
            for at, key, asked in zip(*(batch.column(c).to_pylist() for c in ("base", "key", "asked"))):
                if at != base:
                    base, own, codes = at, [], None
                if not asked:
                    own.append(key)
                    continue
                codes = codes or PartialKeys(own)
                place = codes.correct(key)
                out.append((key, base + place, place < len(own) and own[place] == key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.bool_()))], names=["key", "n_below", "matched"])

    rows = stored.union(located).repartition("base").sortWithinPartitions("base", "asked", "key")
    return rows.mapInArrow(run, "key binary, n_below bigint, matched boolean")


def tag_candidates(keys: DataFrame, view: DataFrame) -> DataFrame:
    """Pairs of a looked-up key and a stored one by hash tag first, then by the key itself."""
    a = keys.withColumn("tag", K.key_tag("key"))
    b = view.withColumn("tag", K.key_tag("key"))
    return a.join(b, ["tag", "key"])

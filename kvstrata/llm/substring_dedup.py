"""Removal of word windows that occur more than once in the corpus.

Pass 1 sketches. Every window of `window` words is represented by its smallest GRAM-word hash (a
minimizer); equal windows at two places have it at two places, so counting the places where
minimizers sit overestimates how often any window occurs. Each partition counts its minimizer places in a
count-min sketch of ROWS rows; sketches are merged cell by cell in parallel (only cells in use
travel, and a task sends a cell once however often it met it), and what later passes need of the
sum is one bit a cell: 2 or more. The cells are sized to the corpus, two for each expected place up to
2**MOST_CELL_BITS, so the broadcast bits have a fixed bound (ROWS * 2**MOST_CELL_BITS / 8 bytes). A fuller
sketch lets more windows through to pass 2; it never loses one.

Pass 2 groups exactly. Windows whose minimizer is estimated repeated are sent to the shard of their
minimizer: a run of neighbours under one minimizer is the minimizer's 64-bit hash, an address, and
64 bits of an independent hash for each window, about 10 bytes a window; equal windows agree on both. Windows
of a minimizer that is frequent (FREQUENT_SHARE of what some task held) are dealt out by their own hash
instead, so a short passage with many surroundings doesn't fill a shard. A window met twice among the
hashes that a task holds is known to be repeated: it is
marked at once and sent a single time, without a return address, so a passage that fills a third
of the corpus costs a shard one entry for each of those. Shards answer the addresses of repeated windows.

Pass 3 deals the texts to buckets, where their marks wait, and removes the covered words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 35
GRAM = 18
ROWS = 2
#: Cells of a row of the sketch at most: 2**29 cells are 64 MB of bits.
MOST_CELL_BITS = 29
#: Characters of text for each place where a minimizer sits, about.
CHARS_PER_PLACE = 55
#: A minimizer is frequent that makes up this share of the places that a task holds, and so many of them.
FREQUENT_SHARE, FREQUENT_PLACES = 1e-3, 200
#: Cells whose counts one task merges at once.
SHARD_BITS = 20
#: Window hashes that a task holds before it sends them.
HELD_ENTRIES = 1_000_000
#: Shards of window hashes, and buckets of documents, for each shuffle partition. A task holds one
#: shard's hashes or one bucket's marks at a time.
SHARDS_PER_PARTITION = 4
BUCKETS_PER_PARTITION = 2

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


class Windows:
    """Word hashes of a slice of texts, and window hashes from their prefix sums."""

    def __init__(self, text: pa.Array, window: int):
        codes, vocabulary, self.at = C.coded_words(text)
        self.window, self.n = window, len(codes)
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in vocabulary.cast(pa.binary()).to_pylist())
        hashes = np.frombuffer(digests, "<u8").reshape(-1, 2)
        self.words = [hashes[:, i][codes] for i in (0, 1)]
        ends = np.repeat(self.at[1:], np.diff(self.at))
        room = ends - np.arange(self.n)
        self.starts = np.flatnonzero(room >= window)

    def rolled(self, which: int, width: int) -> np.ndarray:
        """Hash of the `width` words from each place on (places whose words run short included)."""
        words, base = self.words[which], _BASES[which]
        n = self.n
        powers = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, base, _U))])
        inverse = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, pow(base, -1, 1 << 64), _U))])
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(words * powers[:n])])
        return (sums[width:] - sums[:-width]) * inverse[: n - width + 1]

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window start the smallest gram hash in it; the hashes of all places where one sits."""
        gram = min(GRAM, self.window)
        if not len(self.starts):
            return np.zeros(0, _U), np.zeros(0, _U)
        hashes = np.maximum(_mix(self.rolled(0, gram)), _U(1))
        span = self.window - gram + 1
        least = C.run_min(hashes, span)[self.starts]
        # A place is a minimizer if some window over it has its hash as the smallest one.
        return least, hashes[_over(self.starts, least, len(hashes), span) == hashes]


def _over(starts: np.ndarray, least: np.ndarray, n: int, span: int) -> np.ndarray:
    """Per place p the largest `least` of the windows that start in (p - span, p]; 0 for none."""
    padded = np.zeros(n + span - 1, _U)
    padded[starts + span - 1] = least
    return C.run_max(padded, span)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    odd = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[row]
    return ((h ^ (h >> _U(32))) * _U(odd)) >> _U(64 - bits)


def cell_bits_for(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST_CELL_BITS, max(SHARD_BITS, math.ceil(math.log2(2 * chars / CHARS_PER_PLACE + 1))))


def _frequent(places: np.ndarray, least: int, share: float) -> np.ndarray:
    found, n = np.unique(places, return_counts=True)
    return found[n >= max(least, share * len(places))]


def sketch(docs: DataFrame, window: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row of the merged sketch, its cells that count 2 or more, as packed bits; the frequent minimizers, sorted."""
    shard_bits = min(SHARD_BITS, bits)
    shards = 1 << (bits - shard_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Collect the partition's cells; each leaves with 1 or, if met again, 2.
        held: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            places = np.concatenate(held) if held else np.zeros(0, _U)
            yield from _send([_cells(places, row, bits).astype(np.uint32) for row in range(ROWS)], shards, shard_bits)
            many = _frequent(places, FREQUENT_PLACES, FREQUENT_SHARE)
            if len(many):
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([many.tobytes()], pa.binary())], names=["shard", "cells"])

        for batch in C.slices(batches):
            held.append(Windows(batch.column("text"), window).minimizers()[1])
            if sum(map(len, held)) > 4_000_000:
                yield from sent()
                held = []
        yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(1 << shard_bits, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary())], names=["shard", "cells"])

        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("cells").to_pylist()):
                if shard < 0:  # frequent minimizers go through
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "cells"])
                    continue
                if shard != at:
                    if at is not None:
                        yield done()
                    at = shard
                    counts[:] = 0
                coded = np.frombuffer(blob, np.uint32)
                once, twice = coded[coded >> 31 == 0], coded[coded >> 31 == 1] & 0x7FFFFFFF
                counts[once] = np.minimum(counts[once] + 1, 2)  # a blob has each cell once
                counts[twice] = 2
        if at is not None:
            yield done()

    sent = docs.select("text").mapInArrow(count, "shard int, cells binary")
    merged = sent.repartition(min(C.parts(docs.sparkSession), ROWS * shards), "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, cells binary")
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    width = (1 << shard_bits) // 8
    frequent = [np.zeros(0, _U)]
    for r in merged.collect():  # ROWS * 2**bits / 8 bytes, and 1 / FREQUENT_SHARE minimizers a task at most
        if r["shard"] < 0:
            frequent.append(np.frombuffer(r["cells"], _U))
            continue
        row, shard = divmod(r["shard"], shards)
        out[row][shard * width : (shard + 1) * width] = np.frombuffer(r["cells"], np.uint8)
    return out, np.unique(np.concatenate(frequent))


def _send(held: list[np.ndarray], shards: int, shard_bits: int) -> Iterator[pa.RecordBatch]:
    for row, cells in enumerate(held):
        cells = np.sort(cells)
        if not len(cells):
            continue
        first = np.concatenate([[True], cells[1:] != cells[:-1]])
        again = np.diff(np.append(np.flatnonzero(first), len(cells))) > 1
        cells = cells[first]
        cuts = np.searchsorted(cells, np.arange(shards + 1, dtype=np.int64) << shard_bits)
        low = (cells & np.uint32((1 << shard_bits) - 1)) | (again.astype(np.uint32) << np.uint32(31))
        full = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_arrays([pa.array(row * shards + full, pa.int32()), pa.array([low[cuts[s] : cuts[s + 1]].tobytes() for s in full.tolist()], pa.binary())], names=["shard", "cells"])


def estimated_repeated(h: np.ndarray, bitmaps: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for row, bitmap in enumerate(bitmaps):
        cell = _cells(h, row, bits).astype(np.int64)
        out &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


#: The hashes of a window's minimizer and of itself, its document's place in a list of keys, its start, and where it is sent.
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i4"), ("at", "<i4"), ("shard", "<i4")])
_SENT = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i4"), ("at", "<i4")])
#: As sent: neighbours under one minimizer; their own hashes stand beside. at is -1 where no answer is wanted.
_RUN = np.dtype([("a", "<u8"), ("doc", "<i4"), ("at", "<i4"), ("n", "<i4")])
#: Starts first..last of windows to remove from the document with this key.
_MARK = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("first", "<i4"), ("last", "<i4")])


def _key_columns(id_col: str, text_col: str) -> list:
    """128 bits that tell rows apart by id and text; equal rows share their marks, which are equal too."""
    doc_id, text = C.col(id_col), F.coalesce(C.col(text_col), F.lit(""))
    return [F.xxhash64(doc_id, text).alias("__k1"), F.xxhash64(F.lit(1), text, doc_id).alias("__k2")]


def _together(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries in hash order, the keys they refer to, and which equal the one before."""
    base = np.cumsum([0, *(len(h[1]) for h in held)])
    entry = np.concatenate([h[0] for h in held])
    entry["doc"] += np.repeat(base[:-1], [len(h[0]) for h in held]).astype("<i4")
    entry = entry[np.lexsort((entry["b"], entry["a"]))]
    same = (entry["a"][1:] == entry["a"][:-1]) & (entry["b"][1:] == entry["b"][:-1])
    return entry, np.concatenate([h[1] for h in held]), same


def _mark_rows(entry: np.ndarray, keys: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """The entries' starts as runs of neighbours, packed by the bucket of their document."""
    doc, at = entry["doc"].astype(np.int64), entry["at"].astype(np.int64)
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 1)
    begin = np.flatnonzero(new)
    out = np.empty(len(begin), _MARK)
    out["k1"], out["k2"] = keys[doc[begin]].T
    out["first"], out["last"] = at[begin], at[np.append(begin[1:], len(at)) - 1]
    return _packed(out, out["k1"] % buckets)


def _packed(rows: np.ndarray, to: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1)).tolist()
    return to[edges[:-1]].tolist(), [rows[a:b].tobytes() for a, b in zip(edges, edges[1:])]


def _batch(to: list[int], blobs: list[bytes], keys: list[bytes] | None = None, hashes: list[bytes] | None = None, mark: bool = False) -> pa.RecordBatch:
    n = len(to)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([mark] * n), pa.array(keys or [None] * n, pa.binary()), pa.array(blobs, pa.binary()), pa.array(hashes or [None] * n, pa.binary())], names=["to", "mark", "keys", "entries", "hashes"])


def _sent(held: list, shards: int, buckets: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    entry, keys, same = _together(held)
    first, alone = np.concatenate([[True], ~same]), np.concatenate([~same, [True]])
    alone &= first
    if not alone.all():
        yield _batch(*_mark_rows(entry[~alone], keys, buckets), mark=True)
    send = entry[first]
    known = ~alone[first]  # known already: it counts, but wants no answer
    send["doc"][known], send["at"][known] = 0, -1
    send = send[np.lexsort((send["at"], send["doc"], send["a"], send["shard"]))]
    shard, minimizer, doc, at = (send[c] for c in ("shard", "a", "doc", "at"))
    new = np.ones(len(send), bool)
    new[1:] = (shard[1:] != shard[:-1]) | (minimizer[1:] != minimizer[:-1]) | (doc[1:] != doc[:-1]) | ((at[1:] != at[:-1] + 1) & ((at[1:] >= 0) | (at[:-1] >= 0))) | ((at[1:] >= 0) != (at[:-1] >= 0))
    begin = np.flatnonzero(new)
    size = np.diff(begin, append=len(send))
    # Runs and hashes of a shard lie together; documents are renumbered within it.
    edges = np.flatnonzero(np.diff(shard[begin], prepend=-1, append=-1)).tolist()
    hashes, ends = np.ascontiguousarray(send["b"]), [*begin.tolist(), len(send)]
    blobs, owners, own = [], [], []
    for x, y in zip(edges, edges[1:]):
        part = np.empty(y - x, _RUN)
        part["a"], part["at"], part["n"] = minimizer[begin[x:y]], at[begin[x:y]], size[x:y]
        used, part["doc"] = np.unique(doc[begin[x:y]], return_inverse=True)
        owners.append(keys[used].tobytes())
        blobs.append(part.tobytes())
        own.append(hashes[ends[x] : ends[y]].tobytes())
    yield _batch(shard[begin[edges[:-1]]].tolist(), blobs, owners, own)


def _expanded(runs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.empty(len(hashes), _SENT)
    out["b"] = hashes
    for c in ("a", "doc", "at"):
        out[c] = np.repeat(runs[c], runs["n"])
    out["at"] = np.where(out["at"] < 0, -1, out["at"] + C.ranks_within(runs["n"].astype(np.int64)))
    return out


def _matched(held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    entry, keys, same = _together(held)
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    hit = entry[again & (entry["at"] >= 0)]  # an entry without an address was answered where it came from
    if len(hit):
        to, blobs = _mark_rows(hit, keys, buckets)
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], names=["__bucket", "__marks"])


def marks(docs: DataFrame, window: int, sketched, bits: int, shards: int, buckets: int) -> DataFrame:
    """(__bucket, __marks): the marks of all documents of a bucket, packed, in any number of rows.

    docs: text and the key columns; sketched: what sketch() found, broadcast.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, frequent = sketched.value
        held, size = [], 0
        for batch in C.slices(batches):
            w = Windows(batch.column("text"), window)
            least, _ = w.minimizers()
            likely = estimated_repeated(least, maps, bits)
            starts = w.starts[likely]
            if not len(starts):
                continue
            entry = np.empty(len(starts), _ENTRY)
            entry["a"], entry["b"] = least[likely], w.rolled(1, window)[starts]
            by = np.where(np.isin(entry["a"], frequent), entry["b"], entry["a"])
            entry["shard"] = (by >> _U(20)) % _U(shards)
            doc = np.searchsorted(w.at, starts, "right") - 1
            entry["at"] = starts - w.at[doc]
            used, entry["doc"] = np.unique(doc, return_inverse=True)
            keys = np.stack([batch.column(c).to_numpy()[used] for c in ("__k1", "__k2")], axis=1)
            held.append((entry, keys))
            size += len(entry)
            if size > HELD_ENTRIES:
                yield from _sent(held, shards, buckets)
                held, size = [], 0
        yield from _sent(held, shards, buckets)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            known = batch.filter(batch.column("mark"))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column("to"), known.column("entries")], names=["__bucket", "__marks"])
            for shard, keys, blob, hashes in zip(*(batch.column(c).to_pylist() for c in ("to", "keys", "entries", "hashes"))):
                if keys is None:
                    continue
                if shard != at:
                    yield from _matched(held, buckets)
                    at, held = shard, []
                held.append((_expanded(np.frombuffer(blob, _RUN), np.frombuffer(hashes, _U)), np.frombuffer(keys, np.int64).reshape(-1, 2)))
        yield from _matched(held, buckets)

    sent = docs.select("text", "__k1", "__k2").mapInArrow(look, "to int, mark boolean, keys binary, entries binary, hashes binary")
    dealt = sent.repartition(C.parts(docs.sparkSession), "mark", "to").sortWithinPartitions("mark", "to")
    return dealt.mapInArrow(match, "__bucket int, __marks binary")


def keep_mask(n: int, marked: np.ndarray, window: int) -> np.ndarray:
    """Which of n words no marked window covers."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, marked["first"], 1)
    np.add.at(depth, marked["last"] + window, -1)
    return np.cumsum(depth[:n]) <= 0


class _Marks:
    """The marks of one bucket, by document key."""

    def __init__(self):
        self.bucket, self.blobs, self.table, self.where = None, [], None, None

    def at(self, bucket: int) -> None:
        if bucket != self.bucket:
            self.bucket, self.blobs, self.table, self.where = bucket, [], None, None

    def of(self, k1: int, k2: int) -> np.ndarray | None:
        if self.where is None:
            table = np.frombuffer(b"".join(self.blobs), _MARK)
            table = table[np.lexsort((table["k2"], table["k1"]))]
            new = np.ones(len(table), bool)
            new[1:] = (table["k1"][1:] != table["k1"][:-1]) | (table["k2"][1:] != table["k2"][:-1])
            begin = np.flatnonzero(new)
            ends = np.append(begin[1:], len(table)).tolist()
            self.table, self.where = table, {(int(table["k1"][a]), int(table["k2"][a])): (a, b) for a, b in zip(begin.tolist(), ends)}
        found = self.where.get((k1, k2))
        return None if found is None else self.table[found[0] : found[1]]


def marked_rows(df: DataFrame, id_col: str, text_col: str, window: int, cell_bits: int | None) -> DataFrame:
    """The rows with __k1, __k2, __bucket and __marks, each bucket's marks before its rows.

    Rows of marks have __marks and nothing else; a bucket's rows share a partition.
    """
    spark = df.sparkSession
    n = C.parts(spark)
    rows = df.select("*", *_key_columns(id_col, text_col))
    docs = rows.select(F.coalesce(C.col(text_col), F.lit("")).alias("text"), "__k1", "__k2")
    bits = cell_bits_for(docs) if cell_bits is None else cell_bits
    found = marks(docs, window, spark.sparkContext.broadcast(sketch(docs, window, bits)), bits, n * SHARDS_PER_PARTITION, n * BUCKETS_PER_PARTITION)
    rows = rows.withColumn("__bucket", F.pmod("__k1", F.lit(n * BUCKETS_PER_PARTITION)).cast("int")).withColumn("__marks", F.lit(None).cast("binary"))
    both = rows.unionByName(found, allowMissingColumns=True)
    return both.repartition(n, "__bucket").sortWithinPartitions("__bucket", F.col("__marks").isNull())


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The rows of each batch that aren't marks, and the marks of each or None."""
    state = _Marks()
    for batch in batches:
        mine, found = [], []
        for i, (bucket, blob, k1, k2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__bucket", "__marks", "__k1", "__k2")))):
            state.at(bucket)
            if blob is not None:
                state.blobs.append(blob)
            else:
                mine.append(i)
                found.append(state.of(k1, k2))
        if mine:
            yield batch.take(pa.array(mine)), found


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cell_bits: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by a space).

    A word goes if a window over it occurs at any other place of the input, its own text included.
    Defined cases: a null or empty text has no words and keeps the empty text; texts of any length
    are handled whole; equal rows are places of their own, so their windows repeat; a null id is an
    id like others; an empty table gives no rows; other columns are ignored.
    """
    rows = marked_rows(C.id_text(df, id_col, text_col), "doc_id", "text", window, cell_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _met(batches):
            texts = C.plain(batch.column("text")).cast(pa.binary()).to_pylist()
            columns = list(zip(*(_kept(t, m, window) for t, m in zip(texts, found))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return rows.mapInArrow(run, f"doc_id {C.id_type(df, id_col)}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def deduplicated_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cell_bits: int | None = None) -> DataFrame:
    """The same rows and columns; texts that lose words become their kept words joined by a space."""
    where, n = df.columns.index(text_col), len(df.columns)
    rows = marked_rows(df, id_col, text_col, window, cell_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _met(batches):
            old = batch.column(where)
            new = [t if m is None or t is None else _kept(t.encode(), m, window)[3].decode() for t, m in zip(old.to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([pa.array(new, old.type) if i == where else batch.column(i) for i in range(n)], names=batch.schema.names[:n])

    return rows.mapInArrow(run, df.schema)


def _kept(text: bytes, marked: np.ndarray | None, window: int) -> tuple[int, int, str, bytes]:
    words = text.split()
    kept = words
    if marked is not None:
        kept = [w for w, k in zip(words, keep_mask(len(words), marked, window).tolist()) if k]
    whole = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole

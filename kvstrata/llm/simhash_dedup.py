"""SimHash near-duplicates through a Gray-order hierarchical index.

The index: a node's fingerprints are sorted by Gray rank and cut into groups of FANOUT; the bits that
all members of a group share are factored into the group's upper node (a mask and a pattern), level
by level. A query carries the differences gathered so far down the levels, counts only the bits
that a node newly shares, and drops a whole group once the sum exceeds the limit.

Work is dealt out by nodes: tables of selected bits, a node being the members that agree on a table's
bits. Both modes pick as many bits as leave about NODE_MEMBERS unrelated members a node, whatever the input's size.

* Few bits (near_duplicates, limit at most 3): one table for each 16-bit block, of its leading bits.
  Fingerprints that differ in 3 bits agree on one block, so no link is lost.
* A similarity (near_copies): 128-bit fingerprints of the sets of five-word shingles, tables of
  random bits, as many as leave a pair at similarity 0.8 without a common node with probability MISS.
  What the index finds within WIDE_LIMIT bits is then checked exactly on the shingle sets.

A node with over NODE_SIZE members is split by further bits of the same kind before any task
holds it. Components come from alternating large-star and small-star steps over the links, all in
DataFrames; nothing per document is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCKS = 4
SEED = 42
#: Unrelated members that a node is to have.
NODE_MEMBERS = 128
#: Members of a node beyond which it is split by further bits.
NODE_SIZE = 20_000
#: Members under one node of the index's lowest level.
FANOUT = 4
#: Query and member pairs that one walk may hold at once.
PAIRS_AT_ONCE = 2_000_000
#: Rows of one fingerprint beyond which its component is attached without a shuffle by it.
HOT_ROWS = 1_000

SHINGLE = 5
SIMILARITY = 0.8
#: Bits that may differ between 128-bit fingerprints of sets at SIMILARITY: the mean is 19, the deviation about 4.
WIDE_LIMIT = 34
#: The chance that one bit differs at SIMILARITY, rounded up, and that such a pair shares no node.
BIT_DIFFERS, MISS = 0.16, 1e-3
#: Sets below this size reach SIMILARITY with equal sets only.
LEAST_SET = 4

_U = np.uint64


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; A-Z lower-cased."""
    words = data.lower().split()  # bytes: ASCII letters, and exactly the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return majority(shingle_hashes(words, shingle))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    ends = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


_SPREAD = np.array([int.from_bytes(bytes((x >> i) & 1 for i in range(8)), "little") for x in range(256)], np.uint64)


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):  # 255 ones at most fit a byte lane
        lanes = _SPREAD[hashes[i : i + 255].view(np.uint8).reshape(-1, 8)].sum(axis=0, dtype=np.uint64)
        counts += lanes.view(np.uint8)
    return counts


_BIT = _U(1) << np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    return int(_BIT[2 * ones(hashes) > len(hashes)].sum(dtype=np.uint64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            texts = C.plain(batch.column("text")).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([signed(fingerprint(t, shingle)) for t in texts], pa.int64())], names=["doc_id", "fp"])

    return C.id_text(df, id_col, text_col).mapInArrow(run, f"doc_id {C.id_type(df, id_col)}, fp bigint")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place in the reflected Gray sequence: the prefix XOR of the bits from the top."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> _U(s)
    return out


class GrayIndex:
    """fps: one row of 64-bit words a fingerprint, the first on top.

    levels[l]: (pattern, fresh) of the nodes that stand for FANOUT**l members each; fresh has the bits
    that all members below share and the node above doesn't know of.
    """

    def __init__(self, fps: np.ndarray):
        ranks, odd = [], np.zeros(len(fps), bool)
        for word in fps.T:
            ranks.append(gray_rank(word) ^ np.where(odd, ~_U(0), _U(0)))
            odd ^= (np.bitwise_count(word) & 1).astype(bool)
        self.order = np.lexsort(ranks[::-1])
        levels = [(fps[self.order], np.full(fps.shape, ~_U(0)))]
        while len(levels[-1][0]) > FANOUT:
            pattern, mask = levels[-1]
            at = np.arange(0, len(pattern), FANOUT)
            high = np.bitwise_and.reduceat(pattern & mask, at, axis=0)
            low = np.bitwise_and.reduceat(~pattern & mask, at, axis=0)
            levels.append((high, high | low))
        fresh = [mask & ~np.repeat(above[1], FANOUT, axis=0)[: len(mask)] for (_, mask), above in zip(levels, levels[1:])]
        self.levels = list(zip([p for p, _ in levels], [*fresh, levels[-1][1]]))
        #: Members under upper nodes that walks dropped.
        self.pruned = 0

    def links(self, queries: np.ndarray, after: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in Gray order) within the limit, for places from after[query] on."""
        top = len(self.levels[-1][0])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        differences = np.zeros(len(q), np.uint8)
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, fresh = self.levels[level]
            ahead = (node + 1) * FANOUT**level > after[q]
            q, node, differences = q[ahead], node[ahead], differences[ahead]
            for w in range(queries.shape[1]):
                differences = differences + np.bitwise_count((queries[q, w] ^ pattern[node, w]) & fresh[node, w])
            near = differences <= limit
            if level:
                self.pruned += int((~near).sum()) * FANOUT**level
            q, node, differences = q[near], node[near], differences[near]
            if level:
                below = len(self.levels[level - 1][0])
                q, differences = np.repeat(q, FANOUT), np.repeat(differences, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < below
                q, node, differences = q[inside], node[inside], differences[inside]
        return q, node


def _join(root: np.ndarray, pairs: np.ndarray) -> list[np.ndarray]:
    """Put the pairs' members under one root; the (root, root) pairs that did it."""
    done = []
    while len(pairs):
        top = root[pairs]
        apart = top[:, 0] != top[:, 1]
        pairs, top = pairs[apart], top[apart]
        if not len(pairs):
            break
        high = top.max(axis=1)
        np.minimum.at(root, high, top.min(axis=1))
        joined = np.unique(high)
        done.append(np.stack([joined, root[joined]], axis=1))
        while (root[root] != root).any():
            root[:] = root[root]
    return done


def joined_places(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The members' Gray order, per place in it the least place connected within the limit, and pairs of places that connect all."""
    index = GrayIndex(fps)
    ordered = index.levels[0][0]
    root, out = np.arange(len(fps)), []
    block = max(1, PAIRS_AT_ONCE // len(fps))
    for a in range(0, len(fps), block):
        part = ordered[a : a + block]
        q, other = index.links(part, np.arange(a + 1, a + len(part) + 1), limit)
        out += _join(root, np.stack([q + a, other], axis=1))
    return index.order, root, np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def joining_links(fps: np.ndarray, limit: int) -> np.ndarray:
    """Pairs of fingerprints (one word each) that suffice to join all members connected within the limit."""
    order, _, pairs = joined_places(fps.reshape(-1, 1), limit)
    return fps[order[pairs]]


def _members(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(edges, edges[1:]):
            if held and codes[a] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = codes[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if out:
        pairs = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])


def table_bits(members: int) -> int:
    """Bits that leave NODE_MEMBERS of so many unrelated members a node."""
    return max(0, math.ceil(math.log2(max(members, 1) / NODE_MEMBERS)))


def _large(rows: DataFrame) -> tuple[DataFrame | None, int]:
    """(node, large) of the nodes with over NODE_SIZE members, for a join, and the members of the largest."""
    large = C.cut(rows.groupBy("node").count().filter(F.col("count") > NODE_SIZE))
    found, most = large.agg(F.count("*"), F.max("count")).first()
    if not found:
        return None, 0
    return C.broadcast_if_small(large.select("node", F.lit(True).alias("large")), found), most


def _indexed(rows: DataFrame, node_cols: list[str], work, schema: str) -> DataFrame:
    return rows.select("node", *node_cols).repartition(C.parts(rows.sparkSession), "node").sortWithinPartitions("node").mapInArrow(work, schema)


def _block_nodes(fp: str, width: int, count: int, bits: int, prefix=None):
    """Nodes of fp by the leading `bits` of each of `count` blocks of `width` bits, as hashes."""
    out = []
    for i in range(count):
        value = F.shiftrightunsigned(F.col(fp), (i + 1) * width - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out.append(F.struct(F.xxhash64(*([F.lit(i)] if prefix is None else [F.col(prefix), F.lit(i)]), value).alias("node"), F.lit(i).alias("block")))
    return F.explode(F.array(*out)).alias("k")


def _without(fp: str, width: int):
    """The bits of fp other than block k.block of that width, closed up."""
    low = F.expr(f"{fp} & (shiftleft(1L, k.block * {width}) - 1)")
    high = F.expr(f"if((k.block + 1) * {width} >= 64, 0L, shiftleft(shiftrightunsigned({fp}, (k.block + 1) * {width}), k.block * {width}))")
    return low.bitwiseOR(high)


def links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that suffice for the components.

    Nodes that are too large are split by their whole 16-bit block, then by one of four 12-bit
    blocks of the other 48 bits, of which a linked pair also shares one, then by 9 bits of those left.
    A node is named by a hash: should two meet under one name, they are merely walked together.
    """
    if not 0 <= limit < BLOCKS:
        raise ValueError(f"limit must be below {BLOCKS}")
    bits = min(16, table_bits(fps.count()))
    rows = fps.select("fp", _block_nodes("fp", 16, BLOCKS, bits)).select("fp", "k.node", "k")
    found = None
    for width in (16, 12, 9, None):
        large, _ = _large(rows) if width else (None, 0)
        if large is None:
            small = rows
        else:
            marked = rows.join(large, "node", "left")
            small = marked.filter("large is null")
            rest = marked.filter("large")
            if width == 16:
                rows = rest.select("fp", F.xxhash64("node", F.expr("shiftrightunsigned(fp, k.block * 16) & 65535")).alias("node"), _without("fp", 16).alias("rest"))
            else:
                rows = rest.select("fp", "rest", "node", _block_nodes("rest", width, 4, width, "node")).select("fp", "k.node", _without("rest", width).alias("rest"))
        got = _indexed(small, ["fp"], _walk(limit), "a bigint, b bigint")
        found = got if found is None else found.union(got)
        if large is None:
            break
    return found.distinct()


def _walk(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for node in _members(batches, "node"):
            if node.num_rows > 1:
                out.append(joining_links(np.unique(node.column("fp").to_numpy()).view(np.uint64), limit))
                size += len(out[-1])
            if size > 10_000:
                yield from _pairs(out)
                out, size = [], 0
        yield from _pairs(out)

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the links (a, b), root being the smallest node reachable.

    Large-star then small-star until nothing changes. A step needs a node's smallest neighbour, which
    is a minimum taken before the shuffle, and hands it to the node's links; links of a hub are
    dealt out by what they lead to, and AQE splits the join where one node has most of them.
    Raises when the rounds run out before that.
    """
    now = C.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: neighbours above a node go to its smallest neighbour
        large = both.filter("b > a").join(C.broadcast_if_small(least, 2 * mark["n"]), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # small-star: a node and its smaller neighbours go to the smallest of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(C.broadcast_if_small(floor, 2 * mark["n"]), "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        now = C.cut(moved)
    else:
        raise RuntimeError(f"the components of the links still change after {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _named(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """docs (doc_id, fp, ...) with component_id, the smallest doc_id that links between fps reach.

    A fingerprint that many rows share is joined by broadcast (there are few of those: at most one
    for every HOT_ROWS rows), so its rows never meet in a task.
    """
    distinct = C.cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = C.cut(components(edges).withColumnRenamed("node", "fp"))
    # Only fingerprints with links have to look for their component's least id; a component is one row there.
    linked = C.cut(distinct.join(roots, "fp"))
    by_root = C.cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = linked.join(C.broadcast_if_small(by_root, by_root.count()), "root").select("fp", "n", "component_id")
    alone = distinct.join(roots, "fp", "left_anti").select("fp", "n", F.col("least").alias("component_id"))
    named = C.cut(linked.union(alone).select("fp", "component_id", (F.col("n") > HOT_ROWS).alias("hot")))
    hot = named.filter("hot").drop("hot")
    n = hot.count()
    if not n or n > C.BROADCAST_ROWS:
        return docs.join(named.drop("hot"), "fp")
    rest = docs.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named.filter("not hot").drop("hot"), "fp")
    return docs.join(F.broadcast(hot), "fp").unionByName(rest)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component).

    Texts whose fingerprints differ in `limit` bits or fewer are linked. Defined cases: a null or
    wordless text has fingerprint zero and is linked like any other; texts of any length are
    fingerprinted whole; a null id belongs to its component but never names it (a component of
    null ids only has a null id); equal rows give equal rows; an empty table gives no rows.
    """
    docs = C.cut(fingerprints(df, id_col, text_col, shingle))
    named = _named(docs, links(C.cut(docs.select("fp").distinct()), limit))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by the similarity of shingle sets


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted hashes of the five-word shingles; a shorter text is one shingle, a wordless one has none."""
    words = data.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    return np.unique(shingle_hashes(words, SHINGLE))


def wide_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 majority bits; where half the shingles have a bit, the least shingle decides."""
    out = []
    second = (shingles ^ (shingles >> _U(31))) * _U(0x9E3779B97F4A7C15)
    for h in (shingles, second ^ (second >> _U(29))):
        twice = 2 * ones(h)
        bits = (twice > len(h)) | ((twice == len(h)) & ((h[0] & _BIT) > 0))
        out.append(int(_BIT[bits].sum(dtype=np.uint64)))
    return out[0], out[1]


def _set_key(shingles: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.id_text(df, id_col, text_col).withColumn("row", F.xxhash64(F.lit(SEED), "doc_id", "text"))


def _signed_up(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, fp, f0, f1): a hash of the row, the key of its shingle set and the set's fingerprint, null where it is too small for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            sets = [shingle_set(t) for t in C.plain(batch.column("text")).cast(pa.binary()).to_pylist()]
            wide = [wide_fingerprint(s) if len(s) >= LEAST_SET else (None, None) for s in sets]
            halves = [pa.array([None if w[i] is None else signed(w[i]) for w in wide], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([_set_key(s) for s in sets], pa.int64()), *halves], names=["doc_id", "row", "fp", "f0", "f1"])

    return _rows(df, id_col, text_col).mapInArrow(run, f"doc_id {C.id_type(df, id_col)}, row bigint, fp bigint, f0 bigint, f1 bigint")


def tables(bits: int) -> int:
    """Tables of so many bits that share a pair at SIMILARITY with probability 1 - MISS."""
    same = (1 - BIT_DIFFERS) ** bits
    return 1 if same >= 1 else math.ceil(math.log(MISS) / math.log1p(-same))


def _wide_nodes(rows: DataFrame, bits: int, turn: int, inside: bool = False) -> DataFrame:
    """(node, fp, f0, f1) for every table of random bits; inside: nodes are parts of the rows' nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([SEED, turn])
        chosen = [rng.choice(128, bits, replace=False).tolist() for _ in range(tables(bits))]
        for batch in batches:
            words = [batch.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")]
            above = batch.column("node").to_numpy().view(np.uint64) if inside else _U(0)
            for t, bit in enumerate(chosen):
                value = np.full(batch.num_rows, t + 1, np.uint64)
                for b in bit:
                    value = (value << _U(1)) | ((words[b >> 6] >> _U(b & 63)) & _U(1))
                value = (value ^ above) * _U(0xD6E8FEB86659FD93)
                value = (value ^ (value >> _U(32))) * _U(0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), *(batch.column(c) for c in ("fp", "f0", "f1"))], names=["node", "fp", "f0", "f1"])

    return rows.mapInArrow(run, "node bigint, fp bigint, f0 bigint, f1 bigint")


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, fp): in every node, the members that are connected within WIDE_LIMIT; a family is named by its members."""
    names, members, size = [], [], 0

    def sent() -> Iterator[pa.RecordBatch]:
        if members:
            counts = [len(m) for m in members]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), counts)), pa.array(np.concatenate(members))], names=["family", "fp"])

    for node in _members(batches, "node"):
        if node.num_rows < 2:
            continue
        keys, halves = node.column("fp").to_numpy(), [node.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")]
        order, root, _ = joined_places(np.stack(halves, axis=1), WIDE_LIMIT)
        by = np.argsort(root, kind="stable")
        edges = np.flatnonzero(np.diff(root[by], prepend=-1, append=-1))
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            if b - a > 1:
                own = np.unique(keys[order[by[a:b]]])
                names.append(_set_key(own))
                members.append(own)
                size += len(own)
        if size > 50_000:
            yield from sent()
            names, members, size = [], [], 0
    yield from sent()


def _sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) once for every wanted (row, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            sets = [shingle_set(t).tobytes() for t in C.plain(batch.column("text")).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.binary())], names=["fp", "shingles"])

    wanted = C.cut(wanted)
    texts = _rows(df, id_col, text_col).join(C.broadcast_if_small(wanted, wanted.count()), "row").select("fp", "text")
    return texts.mapInArrow(run, "fp bigint, shingles binary").dropDuplicates(["fp"])


def similar_places(sets: list[np.ndarray], least: float) -> Iterator[np.ndarray]:
    """Pairs of sets whose similarity is at least `least`, checked exactly, a block of sets against all at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1  # others are in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    width = max(1, min(8192, 20_000_000 // len(sets)))
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for a in range(0, len(sets), 1024):
        both = np.zeros((min(1024, len(sets) - a), len(sets)), np.float32)
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[x:y], column[x:y] - k * width] = 1
            both += dense[a : a + 1024] @ dense.T
        both = both.astype(np.float64)
        i, j = np.nonzero(both >= least * (sizes[a : a + 1024, None] + sizes - both))
        later = j > i + a
        yield np.stack([i[later] + a, j[later]], axis=1)


def _checked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for family in _members(batches, "family"):
            keys = family.column("fp").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in family.column("shingles").to_pylist()]
            root = np.arange(len(keys))
            for pairs in similar_places(sets, least):
                out += [keys[p] for p in _join(root, pairs)]
            size += len(keys)
            if size > 10_000:
                yield from _pairs(out)
                out, size = [], 0
        yield from _pairs(out)

    return run


def copy_links(df: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """Links (a, b) between shingle sets that suffice for the components; docs: (row, fp, f0, f1)."""
    nodes = C.cut(docs.filter("f0 is not null").groupBy("fp").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.min("row").alias("row")))
    fps = nodes.select("fp", "f0", "f1")
    rows = _wide_nodes(fps, table_bits(nodes.count()), 0)
    large, most = _large(rows)
    found = None
    if large is not None:
        marked = rows.join(large, "node", "left")
        rows = marked.filter("large is null").unionByName(_wide_nodes(marked.filter("large").select("node", "fp", "f0", "f1"), table_bits(most), 1, True), True)
    found = C.cut(_indexed(rows, ["fp", "f0", "f1"], _families, "family bigint, fp bigint").distinct())
    wanted = nodes.join(found.select("fp").distinct(), "fp", "left_semi").select("row", "fp")
    meeting = found.join(_sets(df, id_col, text_col, wanted), "fp").select("family", "fp", "shingles")
    return meeting.repartition(C.parts(df.sparkSession), "family").sortWithinPartitions("family").mapInArrow(_checked(least), "a bigint, b bigint").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, fingerprint (32 hex digits, null for a text of less than LEAST_SET shingles), component_id.

    Texts are linked whose sets of five-word shingles have a similarity of `least` (SIMILARITY or more).
    Defined cases: null and wordless texts are copies of each other; A-Z count as lower case; texts
    below five words are linked to equal ones only; a null id belongs to its component but never
    names it; equal rows give equal rows; an empty table gives no rows.
    """
    if not SIMILARITY <= least <= 1:
        raise ValueError(f"the similarity must lie between {SIMILARITY} and 1")
    docs = C.cut(_signed_up(df, id_col, text_col))
    named = _named(docs, copy_links(df, docs, id_col, text_col, least))
    return named.select("doc_id", F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("f0", "f1")))).alias("fingerprint"), "component_id")

"""Packing documents into sequences by bin completion with branch and bound.

A document's ids, closed by id 0, form pieces of at most `capacity`; only longer documents are
cut. How many pieces there are of each length is all that the plan needs, and that table has
`capacity` rows at most however large the corpus is. The plan is a list of fillings (lengths that
go together) and how often each is used; pieces are then dealt into it by their rank among the
pieces of equal length, which is counted in parallel.

Bin completion: take the largest length left and complete it to a full sequence with an
undominated filling (one that no swap for a longer piece left over can improve). The best-fit
completion is the first incumbent; other fillings are tried depth first and a branch is dropped
once its waste exceeds what a plan with one sequence less may waste.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import word_tokenizer

CAPACITY = 2048
#: Steps that one completion, and one whole search, may take. They bound the search, not the rows.
COMPLETION_STEPS = 400
SEARCH_STEPS = 400_000
#: Text bytes encoded at once: the more, the fewer times a common piece of a word is looked up.
ENCODE_BYTES = 8 << 20

Filling = tuple[int, ...]


def completions(room: int, left: dict[int, int], sizes: list[int], steps: int, most: int) -> list[Filling]:
    """Undominated fillings of `room` with the pieces left, least waste first; sizes is ascending.

    A step takes a length with all its copies, so the depth is the number of different lengths in
    a filling: below 64 for sequences of 2048.
    """
    found: dict[Filling, int] = {}
    budget = steps

    def go(room: int, high: int, chosen: Filling) -> bool:
        """Fill with lengths below place `high`; True once the room is filled without waste."""
        nonlocal budget
        budget -= 1
        end = bisect_right(sizes, room, 0, high)
        if end and sizes[end - 1] == room and left[room]:
            found[(*chosen, room)] = 0
            return True
        placed = False
        for i in range(end - 1, -1, -1):
            size = sizes[i]
            for k in range(min(left[size], room // size), 0, -1):
                placed = True
                full = go(room - k * size, i, chosen + (size,) * k)
                if full or budget <= 0:
                    return full
        if not placed:
            found.setdefault(chosen, room)
            return room == 0
        return False

    go(room, len(sizes), ())

    def dominated(filling: Filling, waste: int) -> bool:
        used = Counter(filling)
        for size in used:
            i = bisect_right(sizes, size + waste) - 1
            while i >= 0 and sizes[i] > size:
                if left[sizes[i]] > used[sizes[i]]:
                    return True
                i -= 1
        return False

    ranked = sorted(found.items(), key=lambda f: (f[1], tuple(-x for x in f[0])))
    best = [f for f, waste in ranked if waste == ranked[0][1] or not dominated(f, waste)] if ranked else [()]
    return best[:most]


class _Search:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.total = capacity, sum(s * n for s, n in counts.items())
        self.floor = max(-(-self.total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
        self.best: list[tuple[int, Filling]] | None = None
        self.best_bins = 0
        self.steps = SEARCH_STEPS

    def go(self, counts: dict[int, int], branches: int) -> None:
        """Depth first over alternative fillings; each is used as often as its scarcest length allows."""
        start = (dict(counts), sorted(s for s, n in counts.items() if n), [], 0, 0)
        stack = [start]
        while stack:
            left, sizes, plan, bins, waste = stack.pop()
            while sizes:
                if self.best is not None and (waste > (self.best_bins - 1) * self.capacity - self.total or self.steps <= 0):
                    break
                largest = sizes[-1]
                left[largest] -= 1
                options = completions(self.capacity - largest, left, sizes, COMPLETION_STEPS, branches)
                left[largest] += 1
                self.steps -= COMPLETION_STEPS // 4
                for filling in reversed(options[1:]):
                    stack.append((dict(left), list(sizes), [*plan, (0, (largest, *filling))], bins, waste))
                left, sizes, plan, bins, waste = self._use((largest, *options[0]), left, sizes, plan, bins, waste)
            else:
                if self.best is None or bins < self.best_bins:
                    self.best, self.best_bins = plan, bins
            if self.best_bins <= self.floor or self.steps <= 0 and self.best is not None:
                return
            if stack:
                left, sizes, plan, bins, waste = stack.pop()
                stack.append(self._use(plan[-1][1], left, sizes, plan[:-1], bins, waste))

    def _use(self, filling: Filling, left: dict[int, int], sizes: list[int], plan: list, bins: int, waste: int):
        need = Counter(filling)
        times = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= k * times
        sizes = [s for s in sizes if left[s]]
        return left, sizes, [*plan, (times, filling)], bins + times, waste + times * (self.capacity - sum(filling))


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, branches: int = 3) -> list[tuple[int, Filling]]:
    """(times, filling) so that every length is used exactly as often as it is counted."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    if not any(counts.values()):
        return []
    search = _Search(counts, capacity)
    search.go({s: n for s, n in counts.items() if n}, branches)
    return search.best


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        for batch in C.slices(batches, ENCODE_BYTES):
            ids, at = words.encode(batch.column("text"))
            rows, numbers = [], []
            for i in range(batch.num_rows):
                own = ids[at[i] : at[i + 1]].tobytes() + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(own), 4 * capacity)):
                    cut = own[a : a + 4 * capacity]
                    numbers.append(i)
                    rows.append((k, a // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(numbers)), *(pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.int64()]))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return C.id_text(df, id_col, text_col).mapInArrow(run, f"doc_id {C.id_type(df, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint")


def slots(plan: list[tuple[int, Filling]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which filling: a table sorted by (length, first rank)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for size, k in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, taken.get(size, 0), k, sequence, offset))
            taken[size] = taken.get(size, 0) + k * times
            offset += k * size
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "per", "sequence", "offset"), table.T))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, branches: int = 3) -> DataFrame:
    """Every piece with its sequence_id and offset.

    Defined cases: a null or wordless text is the single id 0; a text of any length is cut into
    full pieces and a last one; equal rows are packed each for itself; a null id is kept; an empty
    table gives no rows; other columns are ignored.
    """
    cut = C.cut(pieces(df, tokenizer, id_col, text_col, capacity)).withColumn("part", F.spark_partition_id())
    per_part = cut.groupBy("part", "length").count()
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = df.sparkSession.sparkContext.broadcast(slots(plan_packing(counts, capacity, branches)))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("own", own).join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        shift = 1 << 48
        key = t["length"] * shift + t["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length * shift + rank, "right") - 1
            within = rank - t["rank"][at]
            sequence = t["sequence"][at] + within // t["per"][at]
            offset = t["offset"][at] + within % t["per"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = C.id_type(df, id_col)
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

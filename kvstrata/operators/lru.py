"""Exact LRU results for all cache sizes at once, from reuse distances.

An access misses a cache of c pages iff it is the page's first or at least c distinct pages were
used since the page's last access. With places 1..N and prev(i) the page's last place before i (0 if
none), the distinct pages between p = prev(i) and i number #{j < i: prev(j) <= p} - p.

That count is split so that no task holds more than `chunk` accesses or a table of chunks:
places in the chunk of i are counted there; earlier chunks contribute by the chunk of their prev: whole
chunks from a table of counts, and the chunk of p itself exactly. Since every place is the prev of one
access at most, that group has at most `chunk` accesses as well. The table of counts, by chunk and chunk of
the prev, is added up the same way one level up, in blocks of about the square root of the chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import globally_ranked, materialise

CHUNK = 1 << 18
#: Chunks whose pairs one task adds up at once.
FEW_CHUNKS = 256


def dominated(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """For each query the number (or weight) of points with x < qx and y <= qy, by a merge over x in O(n log n)."""
    weights = np.concatenate([np.ones(len(y), np.int64) if weight is None else weight, np.zeros(len(qy), np.int64)])
    values = np.concatenate([y, qy])
    kind = np.concatenate([np.zeros(len(y), np.int8), np.ones(len(qy), np.int8)])
    # By x, queries before points of the same x; then by rank of (y, points first).
    order = np.lexsort((1 - kind, np.concatenate([x, qx])))
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((kind, values))] = np.arange(len(values))
    rank, is_point, weights = rank[order], kind[order] == 0, weights[order]
    out = np.zeros(len(values), np.int64)
    n, width = len(rank), 1
    place = np.arange(n)
    while width < n:
        # Within blocks of 2 * width: points of the left half below each query of the right half.
        block = place // (2 * width)
        by = np.lexsort((rank, block))
        left = (by // width) % 2 == 0
        seen = np.cumsum(np.where(left, weights[by], 0))
        start = np.searchsorted(block[by], block[by])
        base = np.where(start > 0, seen[np.maximum(start - 1, 0)], 0)
        right_query = ~left & ~is_point[by]
        out[by[right_query]] += (seen - base)[right_query]
        width *= 2
    answers = np.empty(n, np.int64)
    answers[order] = out
    return answers[len(y) :]


def reuse_distances(trace: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(place, page, prev, distance): distance is null for a page's first access.

    trace: (seq, page); seq orders the accesses and needn't be dense.
    """
    at = lambda c: F.floor((F.col(c) - 1) / chunk).cast("long")
    placed = globally_ranked(trace.select("seq", "page"), "seq").select((F.col("rank") + 1).alias("place"), "page").withColumn("c", at("place"))
    # The access before, in the same chunk or else the page's last one in an earlier chunk: a hot page has one row a chunk.
    last = placed.groupBy("page", "c").agg(F.max("place").alias("last"))
    carried = last.select("page", "c", F.lag("last").over(Window.partitionBy("page").orderBy("c")).alias("carried"))
    local = F.lag("place").over(Window.partitionBy("page", "c").orderBy("place"))
    linked = placed.withColumn("local", local).join(carried, ["page", "c"])
    linked = linked.select("place", "page", "c", F.coalesce("local", "carried", F.lit(0)).alias("prev"))
    rows = materialise(linked.withColumn("pc", F.when(F.col("prev") > 0, at("prev")).otherwise(F.lit(-1))))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        q = pdf["prev"].to_numpy() > 0
        place, prev_ = pdf["place"].to_numpy(), pdf["prev"].to_numpy()
        counts = dominated(place, prev_, place[q], prev_[q])
        return pd.DataFrame({"place": place[q], "a": counts})

    def beside(pdf: pd.DataFrame) -> pd.DataFrame:
        c, prev_ = pdf["c"].to_numpy(), pdf["prev"].to_numpy()
        return pd.DataFrame({"place": pdf["place"].to_numpy(), "b": dominated(c, prev_, c, prev_)})

    own = rows.groupBy("c").applyInPandas(inside, "place long, a long")
    same = rows.filter("prev > 0").groupBy("pc").applyInPandas(beside, "place long, b long")
    before = earlier_chunks(rows.groupBy("c", "pc").agg(F.count("*").alias("n")))
    again = rows.filter("prev > 0").join(own, "place").join(same, "place").join(before, ["c", "pc"], "left")
    far = again.select("place", "page", "prev", (F.col("a") + F.col("b") + F.coalesce("t", F.lit(0)) - F.col("prev")).alias("distance"))
    return far.union(rows.filter("prev = 0").select("place", "page", "prev", F.lit(None).cast("long")))


def earlier_chunks(table: DataFrame) -> DataFrame:
    """(c, pc, t) for rows with pc >= 0: the sum of n over the rows with a smaller c and a smaller pc.

    table: (c, pc, n), a row for each pair of chunks in use. Rows are counted inside their block of c, inside their
    block of pc, and by a table of whole blocks, which has about as many rows as there are chunks.
    """
    most = table.agg(F.max("c")).first()[0] or 0
    def counted(x: str, y: str, out: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            q = pdf[pdf["pc"] >= 0] if "pc" in pdf else pdf[pdf["bp"] >= 0]
            sums = dominated(*(pdf[c].to_numpy() for c in (x, y)), q[x].to_numpy(), q[y].to_numpy() - 1, pdf["n"].to_numpy())
            return q[["c", "pc"] if "pc" in pdf else ["bc", "bp"]].assign(**{out: sums})

        return run

    if most < FEW_CHUNKS:  # FEW_CHUNKS ** 2 rows at most
        return table.groupBy().applyInPandas(counted("c", "pc", "t"), "c long, pc long, t long")
    width = math.isqrt(most + 1)
    block = lambda c: F.floor(F.col(c) / width)
    rows = materialise(table.withColumn("bc", block("c")).withColumn("bp", block("pc")))
    own = rows.groupBy("bc").applyInPandas(counted("c", "pc", "a"), "c long, pc long, a long")
    beside = rows.groupBy("bp").applyInPandas(counted("bc", "pc", "b"), "c long, pc long, b long")
    whole = rows.groupBy("bc", "bp").agg(F.sum("n").alias("n")).groupBy().applyInPandas(counted("bc", "bp", "w"), "bc long, bp long, w long")
    sums = rows.filter("pc >= 0").join(own, ["c", "pc"]).join(beside, ["c", "pc"]).join(whole, ["bc", "bp"])
    return sums.select("c", "pc", (F.col("a") + F.col("b") + F.col("w")).alias("t"))


def histogram(distances: DataFrame) -> DataFrame:
    return distances.groupBy("distance").agg(F.count("*").alias("n"))


def sweep(distances: DataFrame, capacities: list[int]) -> DataFrame:
    """(cap, miss_count, hit_count, tot_access) for every capacity, from one pass over the distances."""
    caps = sorted(set(capacities))
    one = distances.select(F.coalesce("distance", F.lit(2**62)).alias("d"))
    hits = [F.sum(F.when(F.col("d") < c, 1).otherwise(0)).alias(f"h{i}") for i, c in enumerate(caps)]
    total = one.agg(F.count("*").alias("n"), *hits)
    rows = F.array(*(F.struct(F.lit(c).cast("long").alias("cap"), F.coalesce(F.col(f"h{i}"), F.lit(0)).cast("long").alias("hit")) for i, c in enumerate(caps)))
    return total.select("n", F.explode(rows).alias("r")).select("r.cap", (F.col("n") - F.col("r.hit")).alias("miss_count"), F.col("r.hit").alias("hit_count"), F.col("n").alias("tot_access"))


def standard_capacities() -> list[int]:
    """112 sizes from 8 to 122,880 pages: each power of two from 8 on in eight equal steps."""
    out = []
    for p in range(3, 17):
        out += [2**p + k * 2**p // 8 for k in range(8)]
    return out[:112]

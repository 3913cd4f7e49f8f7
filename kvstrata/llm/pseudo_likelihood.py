"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word is predicted from the two words on either side, itself left out. The words' embeddings,
one table for each place in the window, are summed and squashed; a softmax over classes and one
inside the class give P(word | window), so probabilities add up to 1. A document's score is the
sum of its words' conditional log-probabilities.

The vocabulary is the corpus's most frequent words (counted over all documents) and hashed
buckets for the rest. A word in a bucket has the bucket's probability times the word's share of
the bucket's words in the whole corpus, so rare words are as unlikely as they are rare. The counts
stay distributed: the KNOWN most frequent words' are broadcast, all others are joined. Words are
told apart by 64 bits of hash.

Training runs in rounds over every position of the corpus (each falls to one of `rounds` turns).
Documents are dealt to shards of about SHARD_WORDS words by a hash of id and text. A shard starts
from the shared weights and takes AdaGrad steps in numpy over its documents in the hash's order;
the shards' weights are averaged in the shards' order, FAN_IN tables at a time. Neither
the shards nor any order depends on how the input is partitioned, and so the scores don't.

Defined cases: a null or wordless text scores 0 over 0 words and a null mean; texts of any length
are scored whole; equal rows score equally; an empty table gives no rows; other columns are ignored.
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
from .importance import kth_largest

CLASSES = 48
PER_CLASS = 48
SIZE = CLASSES * PER_CLASS
#: The last class holds hashed buckets for words outside the vocabulary.
VOCABULARY = SIZE - PER_CLASS
REACH = 2
WIDTH = 16
#: Positions of one gradient step.
BATCH = 4096
#: Words of one shard, and words whose positions are mixed before they are cut into batches.
SHARD_WORDS = 1_000_000
MIXED_WORDS = 200_000
#: Tables of weights that one task averages.
FAN_IN = 16
#: Words whose counts are broadcast: 8 MB.
KNOWN = 1 << 19
SEED = 42

#: Score this many words at once; the arrays stay small enough to be reused by the allocator.
SCORE_BLOCK = 16384
#: Logarithms of counts are summed as whole numbers of 1 / LOG_UNIT, so that the order of a sum doesn't matter.
LOG_UNIT = 1 << 32


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


class Network:
    """E: window embeddings (one table a place, SIZE stands for no word); Wc, bc: classes; Ww, bw: words in a class."""

    SHAPES = {"E": (2 * REACH, SIZE + 1, WIDTH), "b": (WIDTH,), "Wc": (WIDTH, CLASSES), "bc": (CLASSES,), "Ww": (CLASSES, WIDTH, PER_CLASS), "bw": (CLASSES, PER_CLASS)}

    def __init__(self, blob: bytes | None = None):
        self.p: dict[str, np.ndarray] = {}
        rng, flat, at = np.random.default_rng(SEED), None if blob is None else np.frombuffer(blob, np.float32), 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            if flat is None:
                self.p[name] = (rng.normal(0, 0.1, shape) if len(shape) > 2 else np.zeros(shape)).astype(np.float32)
            else:
                self.p[name] = flat[at : at + n].reshape(shape).copy()
            at += n
        self.squares = {name: np.full(shape, 1e-6, np.float32) for name, shape in self.SHAPES.items()}

    def blob(self) -> bytes:
        return b"".join(self.p[name].tobytes() for name in self.SHAPES)

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """near: word numbers by place in the window."""
        total = self.p["E"][0][near[0]]
        for k in range(1, 2 * REACH):
            total += self.p["E"][k][near[k]]
        total += self.p["b"]
        return np.tanh(total, out=total)

    @staticmethod
    def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order that puts words of a class together, and (class, first, end) in it."""
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]

    def log_probabilities(self, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        kind, inner = np.divmod(word, PER_CLASS)
        order, classes = self._by_class(kind)
        h, kind, inner = self.hidden(near[:, order]), kind[order], inner[order]
        rows = np.arange(len(word))
        z = h @ self.p["Wc"] + self.p["bc"]
        z -= z.max(axis=1, keepdims=True)
        got = z[rows, kind] - np.log(np.exp(z, out=z).sum(axis=1))
        for c, a, b in classes:
            np.matmul(h[a:b], self.p["Ww"][c], out=z[a:b])
            z[a:b] += self.p["bw"][c]
        z -= z.max(axis=1, keepdims=True)
        got += z[rows, inner] - np.log(np.exp(z, out=z).sum(axis=1))
        out = np.empty(len(word))
        out[order] = got
        return out

    def _step(self, name: str, at, gradient: np.ndarray, rate: float) -> None:
        squares = self.squares[name]
        squares[at] += gradient * gradient
        self.p[name][at] -= rate * gradient / np.sqrt(squares[at])

    def learn(self, near: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One AdaGrad step on a batch."""
        n, rows = len(word), np.arange(len(word))
        kind, inner = np.divmod(word, PER_CLASS)
        order, classes = self._by_class(kind)
        near, kind, inner = near[:, order], kind[order], inner[order]
        h = self.hidden(near)
        z = _softmax(h @ self.p["Wc"] + self.p["bc"])
        z[rows, kind] -= 1
        back = z @ self.p["Wc"].T
        steps = [("Wc", slice(None), h.T @ z), ("bc", slice(None), z.sum(axis=0))]
        for c, a, b in classes:
            np.matmul(h[a:b], self.p["Ww"][c], out=z[a:b])
            z[a:b] += self.p["bw"][c]
        _softmax(z)
        z[rows, inner] -= 1
        inside, bias = np.zeros_like(self.p["Ww"]), np.zeros_like(self.p["bw"])
        for c, a, b in classes:
            back[a:b] += z[a:b] @ self.p["Ww"][c].T
            inside[c], bias[c] = h[a:b].T @ z[a:b], z[a:b].sum(axis=0)
        back *= 1 - h * h
        steps += [("Ww", slice(None), inside), ("bw", slice(None), bias), ("b", slice(None), back.sum(axis=0))]
        for k in range(2 * REACH):
            by = np.argsort(near[k], kind="stable")
            at = near[k][by]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            steps.append(("E", (k, at[first]), np.add.reduceat(back[by], first, axis=0)))
        for name, at, gradient in steps:
            self._step(name, at, gradient / n, rate)


def word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word, SEED)
    return h - (1 << 64) if h >> 63 else h


def bucket(h):
    """The number of the bucket of words with this hash."""
    return VOCABULARY + h % PER_CLASS


def _hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words, the hashes of the distinct ones, and where each text begins."""
    codes, words, at = C.coded_words(text)
    return codes, np.array([xxhash.xxh3_64_intdigest(w, SEED) for w in words.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64), at


def word_counts(df: DataFrame) -> DataFrame:
    """(word, n) over all rows, words by their hash; a slice sends each of its words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 16 << 20):
            codes, words, _ = _hashed(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], names=["word", "n"])

    return df.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Word hashes in order with their counts and numbers, for the corpus's most frequent words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        by = np.lexsort((words, -counts))
        words, counts = words[by], counts[by]
        number = np.where(np.arange(len(words)) < VOCABULARY, np.arange(len(words)), bucket(words))
        by = np.argsort(words)
        self.words, self.numbers, self.counts = words[by], number[by], counts[by]

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words in the network, and their counts: 1 for vocabulary words, 0 where the count isn't known."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        hit = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        number = bucket(words)
        number[hit] = self.numbers[at[hit]]
        count = np.zeros(len(words), np.int64)
        count[hit] = np.where(number[hit] < VOCABULARY, 1, self.counts[at[hit]])
        return number, count


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of the most frequent words: `most` at most; of equally frequent ones all or none."""
    total = counts.count()
    least = kth_largest(counts.withColumn("n", F.col("n").cast("double")), "n", min(most, total)) if total else 0
    if counts.filter(F.col("n") >= least).count() > most:
        least += 1
    found = counts.filter(F.col("n") >= least).select("word", "n").toArrow()
    return found.column("word").to_numpy(), found.column("n").to_numpy()


def windows(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per place in the window, the neighbour of every word; SIZE beyond the text's ends."""
    n = len(numbers)
    near = np.full((2 * REACH, n), SIZE, numbers.dtype)
    edges = at[1:-1]
    for k, d in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        if abs(d) >= n:
            continue
        if d < 0:
            near[k, -d:] = numbers[:d]
        else:
            near[k, :-d] = numbers[d:]
        for s in range(abs(d)):  # words whose neighbour lies in another text
            over = edges + s if d < 0 else edges - 1 - s
            near[k, over[(over >= 0) & (over < n)]] = SIZE
    return near


def _own_edges(at: np.ndarray) -> np.ndarray:
    """Places where texts begin; those without words aside."""
    return np.unique(at)


def _encoded(rows: DataFrame, vocabulary, shards: int) -> DataFrame:
    """doc_id, row, shard, h, n_words, codes (16 bits a word), known (log counts of words in buckets) and, of words whose counts aren't broadcast, rare and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 8 << 20):
            codes, words, at = _hashed(batch.column("text"))
            number, count = vocabulary.value.look(words)
            log = np.rint(np.log(np.maximum(count, 1)) * LOG_UNIT).astype(np.int64)
            mine = number.astype(np.uint16)[codes]
            place = np.flatnonzero(count[codes] == 0)
            owner = np.searchsorted(at, place, side="right") - 1
            pairs, times = np.unique(owner * max(len(words), 1) + codes[place], return_counts=True)
            edges = pa.array(np.searchsorted(pairs, np.arange(len(at)) * max(len(words), 1)), pa.int32())
            data, bounds = mine.tobytes(), (2 * at).tolist()
            columns = [
                pa.array(np.diff(at), pa.int64()),
                pa.array([data[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
                pa.array(C.sums_at(log[codes], at), pa.int64()),
                pa.ListArray.from_arrays(edges, pa.array(words[pairs % max(len(words), 1)] if len(pairs) else pairs, pa.int64())),
                pa.ListArray.from_arrays(edges, pa.array(times, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "shard", "h")), *columns], names=["doc_id", "row", "shard", "h", "n_words", "codes", "known", "rare", "times"])

    kind = dict(rows.dtypes)["doc_id"]
    keyed = rows.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "text")).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    return keyed.mapInArrow(run, f"doc_id {kind}, row bigint, shard int, h bigint, n_words bigint, codes binary, known bigint, rare array<bigint>, times array<int>")


def _averaged(tables: DataFrame) -> bytes | None:
    """The mean of (at, n, blob) rows by weight n, merged FAN_IN at a time in the order of `at`; no task or driver holds more."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["at", "n", "blob"])

        for batch in batches:
            for to, k, blob in zip(*(batch.column(c).to_pylist() for c in ("to", "n", "blob"))):
                if to != at:
                    if at is not None:
                        yield done()
                    at, n, total = to, 0, 0.0
                total = total + np.frombuffer(blob, np.float32).astype(np.float64) * k
                n += k
        if at is not None:
            yield done()

    tables = C.cut(tables)
    count = tables.agg(F.max("at")).first()[0]
    if count is None:
        return None
    while True:
        count //= FAN_IN
        grouped = tables.withColumn("to", F.floor(F.col("at") / FAN_IN).cast("int"))
        parts = min(count + 1, C.parts(tables.sparkSession))
        tables = C.cut(grouped.repartition(parts, "to").sortWithinPartitions("to", "at").mapInArrow(merge, "at int, n bigint, blob binary"))
        if not count:
            return tables.first()["blob"]


def train(shards: DataFrame, rounds: int, rate: float) -> bytes:
    """shards: (shard, codes), whole shards in each partition, their documents in a fixed order."""
    blob = Network().blob()
    sc = shards.sparkSession.sparkContext
    for turn in range(rounds):
        shared = sc.broadcast(blob)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, network, n = None, Network(), 0
            held: list[np.ndarray] = []
            words = 0

            def learn() -> int:
                numbers = np.concatenate(held) if held else np.zeros(0, np.uint16)
                at = np.cumsum([0, *map(len, held)])
                near = windows(numbers, _own_edges(at))
                # Alternate words fall to alternate turns; the next mix starts anew.
                picked = np.random.default_rng([SEED, turn, len(numbers)]).permutation(np.arange(turn, len(numbers), rounds))
                for i in range(0, len(picked), BATCH):
                    part = picked[i : i + BATCH]
                    network.learn(near[:, part], numbers[part].astype(np.int64), rate)
                return len(picked)

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([network.blob()], pa.binary())], names=["at", "n", "blob"])

            for batch in batches:
                for to, codes in zip(batch.column("shard").to_pylist(), batch.column("codes").to_pylist()):
                    if to != shard or words > MIXED_WORDS:
                        n += learn()
                        held, words = [], 0
                    if to != shard:
                        if n:
                            yield done()
                        shard, network, n = to, Network(shared.value), 0
                    held.append(np.frombuffer(codes, np.uint16))
                    words += len(held[-1])
            n += learn()
            if n:
                yield done()

        blob = _averaged(shards.mapInArrow(run, "at int, n bigint, blob binary")) or blob
    return blob


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, rate: float = 0.1) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over the words), mean_log_likelihood."""
    if rounds < 0:
        raise ValueError("rounds must not be negative")
    rows = C.id_text(df, id_col, text_col)
    sc = df.sparkSession.sparkContext
    counts = C.cut(word_counts(rows))
    n_words = counts.agg(F.sum("n")).first()[0] or 0
    words = Vocabulary(*frequent(counts, KNOWN))
    vocabulary = sc.broadcast(words)
    totals = np.zeros(SIZE)
    for r in counts.groupBy(F.pmod(F.col("word"), F.lit(PER_CLASS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[VOCABULARY + r["bucket"]] = r["n"]
    inside = words.numbers < VOCABULARY
    np.subtract.at(totals, bucket(words.words[inside]), words.counts[inside])
    totals = np.log(np.maximum(totals, 1))
    n = C.parts(df.sparkSession)
    coded = _encoded(rows, vocabulary, max(1, math.ceil(n_words / SHARD_WORDS)))
    coded = C.cut(coded.repartition(n, C.dealt_evenly(df.sparkSession, F.col("shard"), n)).sortWithinPartitions("shard", "h"))
    shared = sc.broadcast(train(coded.filter("n_words > 0").select("shard", "codes"), rounds, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shared.value)
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            numbers = np.frombuffer(b"".join(codes), np.uint16)
            at = np.cumsum([0, *(len(c) // 2 for c in codes)])
            near = windows(numbers, _own_edges(at))
            scores = np.zeros(len(numbers) + 1)
            for i in range(0, len(numbers), SCORE_BLOCK):
                part = slice(i, i + SCORE_BLOCK)
                word = numbers[part].astype(np.int64)
                scores[:-1][part] = network.log_probabilities(near[:, part], word) - totals[word]
            part = np.add.reduceat(scores, at[:-1]) if len(codes) else np.zeros(0)
            part[np.diff(at) == 0] = 0
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row", "n_words", "known")] + [pa.array(part)], names=["doc_id", "row", "n_words", "known", "part"])

    kind = C.id_type(df, id_col)
    scored = coded.select("doc_id", "row", "n_words", "known", "codes").mapInArrow(run, f"doc_id {kind}, row bigint, n_words bigint, known bigint, part double")
    own = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    log = F.rint(F.log("n") * F.lit(float(LOG_UNIT))).cast("bigint")
    own = own.join(counts.filter("n > 1").withColumn("log", log), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("own"))
    whole = F.col("part") + (F.col("known") + F.coalesce("own", F.lit(0))) / F.lit(float(LOG_UNIT))
    return scored.join(own, "row", "left").select("doc_id", "n_words", whole.alias("log_likelihood"), F.when(F.col("n_words") > 0, whole / F.col("n_words")).alias("mean_log_likelihood"))

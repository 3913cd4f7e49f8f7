"""SentencePiece BPE encoding with seeded merge-dropout, and its decoding.

The agenda holds the mergeable neighbours of a text, best piece first, leftmost first among equal
ones. A keyed hash of (seed, document, unit's place in the text, place in the unit, left, right)
decides whether a candidate is skipped for good when it comes up: every occurrence of a word is cut by
its own decisions, and a seed always gives the same segmentation of a document. The document enters
by the hash of its id and text.

No piece holds a space after another character, a line feed or the space mark itself, so merges
never cross those, and the agenda runs over each unit (spaces and the word after them) alone. Units of
one length take their steps together in numpy: each step merges every unit's best candidate and
offers the two candidates that the merge makes. Long units use a heap. What a unit looks like before
its first merge is worked out once for each distinct unit of a slice.
The space mark as a literal
character, and characters without a piece, become bytes, so decoding gives the text back exactly.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = "▁"
UNIT = re.compile(f" *[^ \n{SPACE}]+| +|\n|{SPACE}")
#: Units up to this many characters are merged together in numpy, about so many characters at once.
SHORT = 32
TOGETHER = 150_000
#: Text bytes whose units are taken together.
SLICE_BYTES = 4 << 20
_FOREIGN = 1 << 21  # symbols of characters without a piece: _FOREIGN + code point
_NEVER = np.int32(2**31 - 1)
_U = np.uint64


class Pieces:
    """The merge table of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes_at = next(i for i in ids if model.is_byte(i))
        normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        piece = {model.id_to_piece(i): i for i in normal}
        self.raw = [b""] * len(ids)
        for p, i in piece.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b in range(256):
            self.raw[self.bytes_at + b] = bytes([b])
        self.text = pa.array(self.raw, pa.binary())
        #: Symbols by code point; the space mark stands for a space and has none of its own.
        self.symbol = np.arange(0x110000, dtype=np.int32) + _FOREIGN
        for p, i in piece.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self.symbol[ord(SPACE)] = _FOREIGN + ord(SPACE)
        by_score = sorted(piece.items(), key=lambda x: -model.get_score(x[1]))
        rank = {p: r for r, (p, _) in enumerate(by_score)}
        symbol = lambda p: piece.get(p, _FOREIGN + ord(p) if len(p) == 1 else None)
        #: left << 32 | right: rank, piece made
        self.merges = {}
        for p, i in piece.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    self.merges[a << 32 | b] = (rank[p], i)
        self._hashed()

    def _hashed(self) -> None:
        """The merges as an open hash table, for many look-ups at once."""
        keys = np.array(list(self.merges), np.int64)
        values = np.array(list(self.merges.values()), np.int32).reshape(-1, 2)
        self.bits = max(4, len(keys).bit_length() + 2)
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.made = np.full(1 << self.bits, _NEVER), np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.table[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.table[slot[won]] = keys[won]
            self.rank[slot[won]], self.made[slot[won]] = values[won].T
            left = left[self.table[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(_U) * _U(0x9E3779B97F4A7C15)
        return ((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NEVER if none) and made piece of each pair."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.table[slot]
        again = np.flatnonzero((found != keys) & (found >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & (len(self.table) - 1)
            found = self.table[slot[again]]
            again = again[(found != keys[again]) & (found >= 0)]
        return self.rank[slot], self.made[slot]

    def symbols(self, unit: str) -> list[int]:
        return self.symbol[np.frombuffer(unit.encode("utf-32-le"), np.uint32)].tolist()

    def expand(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, characters without a piece as the ids of their bytes; at: places among them, carried along."""
        foreign = np.flatnonzero(symbols >= _FOREIGN)
        if not len(foreign):
            return symbols, at
        raw = [chr(s).encode() for s in (symbols[foreign] - _FOREIGN).tolist()]
        width = np.ones(len(symbols), np.int64)
        width[foreign] = [len(b) for b in raw]
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(symbols, width)
        where = np.repeat(ends[foreign], width[foreign]) + C.ranks_within(width[foreign])
        out[where] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.bytes_at
        return out, ends[at]


def skipped(key: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidates are skipped; key: hash of seed, document and the unit's place."""
    h = key ^ (start.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ ((left.astype(_U) << _U(32) | right.astype(_U)) * _U(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return (h ^ (h >> _U(31))) < _U(min(int(rate * 2.0**64), 2**64 - 1))


class Encoder:
    def __init__(self, path: str, rate: float, seed: int):
        if not 0 <= rate <= 1:
            raise ValueError("the dropout rate must lie between 0 and 1")
        self.pieces, self.rate, self.seed = Pieces(path), rate, seed

    def _together(self, sym: np.ndarray, rank: np.ndarray, made: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Final symbols of units of one length, -1 where one was merged away. rank, made: by the left symbol's place, all candidates."""
        n, width = sym.shape
        out = np.empty_like(sym)
        if self.rate:
            at = np.flatnonzero(rank.ravel() < _NEVER)
            row, start = np.divmod(at, width)
            flat = sym.ravel()
            rank.ravel()[at[skipped(key[row], start, flat[at], flat[at + 1], self.rate)]] = _NEVER
        after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
        rows = np.arange(n)
        while True:
            best = rank.argmin(axis=1)
            base = np.arange(len(rows)) * width
            a = base + best
            go = rank.ravel()[a] < _NEVER
            if not go.all():
                out[rows[~go]] = sym[~go]
                rows, sym, rank, made, key, after, before, best = (x[go] for x in (rows, sym, rank, made, key, after, before, best))
                base = np.arange(len(rows)) * width
                a = base + best
            if not len(rows):
                return out
            fs, fr, fm, fa, fb = (x.ravel() for x in (sym, rank, made, after, before))
            b = base + fa[a]
            fs[a], fs[b], fr[b] = fm[a], -1, _NEVER
            beyond = fa[b]
            fa[a] = beyond
            right = np.flatnonzero(beyond < width)
            fb[base[right] + beyond[right]] = best[right]
            left = np.flatnonzero(fb[a] >= 0)
            fr[a] = _NEVER
            first = np.concatenate([a[right], base[left] + fb[a[left]]])
            second = np.concatenate([base[right] + beyond[right], a[left]])
            owner = np.concatenate([right, left])
            ranks, makes = self.pieces.look(fs[first], fs[second])
            if self.rate:
                on = np.flatnonzero(ranks < _NEVER)
                ranks[on[skipped(key[owner[on]], first[on] - base[owner[on]], fs[first[on]], fs[second[on]], self.rate)]] = _NEVER
            fr[first], fm[first] = ranks, makes

    def _agenda(self, unit: str, key: int) -> list[int]:
        """The same by a heap, for a long unit."""
        sym = self.pieces.symbols(unit)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.pieces.merges
        agenda: list[tuple[int, int, int, int]] = []
        whole, most = (1 << 64) - 1, min(int(self.rate * 2.0**64), (1 << 64) - 1)

        def skip(a: int, left: int, right: int) -> bool:
            h = key ^ (a * 0x9E3779B97F4A7C15 & whole) ^ ((left << 32 | right) * 0xC2B2AE3D27D4EB4F & whole)
            h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & whole
            h = (h ^ (h >> 27)) * 0x94D049BB133111EB & whole
            return h ^ (h >> 31) < most

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (m := merges.get(sym[a] << 32 | sym[b])):
                heapq.heappush(agenda, (m[0], a, sym[a], sym[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, left, right = heapq.heappop(agenda)
            b = after[a]
            if sym[a] != left or b >= n or sym[b] != right or skip(a, left, right):
                continue
            sym[a], sym[b] = merges[left << 32 | right][1], -1
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in sym if s >= 0]

    def occurrences(self, codes: np.ndarray, units: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units in turn, and where each unit's begin; codes: numbers of distinct units."""
        length = pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        size = length[codes]
        by = np.argsort(np.minimum(size, SHORT + 1).astype(np.uint8), kind="stable")
        count = np.zeros(len(codes), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # occurrences, their symbols side by side
        edges = np.searchsorted(size[by], np.arange(1, SHORT + 2)) if len(by) else np.zeros(SHORT + 1, np.int64)
        for width, (x, y) in enumerate(zip(edges.tolist(), edges[1:].tolist()), 1):
            if x == y:
                continue
            used, local = np.unique(codes[by[x:y]], return_inverse=True)
            points = np.frombuffer("".join(units.take(pa.array(used)).to_pylist()).encode("utf-32-le"), np.uint32)
            sym = self.pieces.symbol[points].reshape(-1, width)
            rank, made = np.full(sym.shape, _NEVER), np.full(sym.shape, -1, np.int32)
            if width > 1:
                rank[:, :-1], made[:, :-1] = (r.reshape(-1, width - 1) for r in self.pieces.look(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
            step = max(1, TOGETHER // width)
            for a in range(x, y, step):
                at, own = by[a : min(a + step, y)], local[a - x : min(a + step, y) - x]
                got = self._together(sym[own], rank[own], made[own], keys[at])
                kept = got >= 0
                count[at] = kept.sum(axis=1)
                done.append((at, got[kept]))
        for at in by[edges[-1] :].tolist():
            got = np.array(self._agenda(units[int(codes[at])].as_py(), int(keys[at])), np.int32)
            count[at] = len(got)
            done.append((np.array([at]), got))
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int32)
        for at, got in done:
            out[np.repeat(begin[at], count[at]) + C.ranks_within(count[at])] = got
        return out, begin

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the space put in front of every text is taken off."""
        return b"".join(map(self.pieces.raw.__getitem__, ids.tolist()))[1:]


def units_of(text: str) -> list[str]:
    return UNIT.findall(" " + text) if text else []


def _encoded(batch: pa.RecordBatch, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where each text's begin."""
    split = [units_of(t) for t in C.plain(batch.column("text")).to_pylist()]
    sizes = np.array([len(u) for u in split], np.int64)
    salt = _U(encoder.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    own = batch.column("h").to_numpy().view(_U) ^ salt
    keys = np.repeat(own, sizes) + C.ranks_within(sizes).astype(_U) * _U(0xD6E8FEB86659FD93)
    keys = (keys ^ (keys >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    coded = pa.array([u for units in split for u in units], pa.string()).dictionary_encode()
    symbols, begin = encoder.occurrences(coded.indices.to_numpy(), coded.dictionary, keys ^ (keys >> _U(29)))
    return encoder.pieces.expand(symbols, begin[np.concatenate([[0], np.cumsum(sizes)])])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.id_text(df, id_col, text_col).withColumn("h", F.xxhash64("doc_id", "text"))


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, seed: int = 42) -> DataFrame:
    """(doc_id, ids array<int>) of every row.

    Defined cases: a null or empty text has no ids; texts and units of any length are encoded
    whole; equal rows get equal ids; a null id is an id like any other; an empty table gives
    no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, rate, seed)
        for batch in C.slices(batches, SLICE_BYTES):
            ids, at = _encoded(batch, encoder)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return _keyed(df, id_col, text_col).mapInArrow(run, f"doc_id {C.id_type(df, id_col)}, ids array<int>")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, 0, 0)
        for batch in batches:
            texts = [encoder.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return df.select(C.col(id_col).alias("doc_id"), C.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {C.id_type(df, id_col)}, text string")


def round_trips(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, seed: int = 42) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids) and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, rate, seed)
        for batch in C.slices(batches, SLICE_BYTES):
            ids, at = _encoded(batch, encoder)
            whole = encoder.pieces.text.take(pa.array(ids))
            data, begin = C.byte_data(whole)
            begin, data = begin[at].tolist(), data.tobytes()
            texts = C.plain(batch.column("text")).cast(pa.binary()).to_pylist()
            same = [data[a + (b > a) : b] == t for a, b, t in zip(begin, begin[1:], texts)]
            raw, edges = memoryview(ids.astype("<i4").tobytes()), (4 * at).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "lossless"])

    return _keyed(df, id_col, text_col).mapInArrow(run, f"doc_id {C.id_type(df, id_col)}, n_ids bigint, ids_crc32 bigint, lossless boolean")

"""Token ids of whole texts with a public tokenizer file, word by word.

The tokenizer never joins characters across ASCII white space (its pre-tokenizer drops white space
and its normal form doesn't compose across it), so the ids of a text are those of its words in
turn.

A word of printable Latin-1 characters is its own normal form but for case. The distinct words of a slice
are lower-cased and cut by the pre-tokenizer's pattern all at once, on their bytes, and each distinct
piece goes to the library's BPE model directly. Words with an apostrophe are cut one by one, and all other
words go through the library's whole chain. A cache of bounded size keeps the pieces for later.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
import regex

from . import common as C

#: Pieces of words, and whole words that aren't cut, that a worker keeps encoded; beyond this it starts afresh.
CACHE_PIECES = 450_000

#: Words whose normal form is their lower case: printable Latin-1 without the no-break space.
_SIMPLE = regex.compile(r"[!-~¡-ÿ]+")

_WHOLE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """What each Latin-1 character is to the pre-tokenizer's pattern; _WHOLE keeps its word from being cut here."""
    kind = lambda c: _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _OTHER
    return np.array([kind(chr(i)) if _SIMPLE.match(chr(i)) and chr(i) != "'" else _WHOLE for i in range(256)], np.uint8)


_KINDS = _kinds()


def cut_words(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased pieces of all words in order, which of them are words left whole and as they are, and where each word's pieces begin (one more at the end)."""
    data, at = C.byte_data(words)
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[begin]
    # UTF-8 writes U+0080 to U+00BF as C2 80 to C2 BF, U+00C0 to U+00FF as C3 80 to C3 BF.
    second = data[np.minimum(begin + 1, len(data) - 1)]
    code = np.where(first < 0x80, first, np.where(first == 0xC2, second, np.where(first == 0xC3, second + np.uint8(0x40), np.uint8(0))))
    kind = _KINDS[code]
    kind[:-1][(code[:-1] == ord("<")) & (code[1:] == ord("|"))] = _WHOLE
    chars_at = np.searchsorted(begin, at)
    chars = np.diff(chars_at)
    whole = np.zeros(len(words), bool)
    whole[np.searchsorted(chars_at, np.flatnonzero(kind == _WHOLE), "right") - 1] = True
    free = ~np.repeat(whole, chars)
    starts = np.ones(len(begin), bool)
    starts[1:] = free[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER))
    starts[chars_at[:-1]] = True
    lower = data.copy()
    capital = free & (((code >= 0x41) & (code <= 0x5A)) | ((code >= 0xC0) & (code <= 0xDE) & (code != 0xD7)))
    lower[begin[capital] + (first[capital] >= 0x80)] += 0x20
    offsets = np.append(begin[starts], len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(lower))
    return pieces, ~free[starts], np.searchsorted(offsets, at)


def byte_marks() -> dict[int, str]:
    """How byte-level BPE spells each Latin-1 character: bytes that print stand for themselves, the rest follow from 256 on."""
    printing = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    mark = {b: chr(b if b in printing else next(rest)) for b in range(256)}
    return {c: "".join(mark[b] for b in chr(c).encode()) for c in range(128, 256)}


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.marks = byte_marks()
        # Fixed value: the pattern that the tokenizer file splits normalised text by.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        return self._new_piece(piece) if got is None else got

    def _new_piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.translate(self.marks)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def _learn(self, missing: list[str], whole: list[bool]) -> None:
        cache, others = self.pieces, []
        for piece, uncut in zip(missing, whole):
            if not uncut:
                cache[piece] = self._new_piece(piece)
            elif _SIMPLE.fullmatch(piece) and "<|" not in piece:
                cache[piece] = b"".join(map(self._piece, self.cut(piece.lower())))
            else:
                others.append(piece)
        for i in range(0, len(others), 10_000):
            part = others[i : i + 10_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                cache[word] = array("I", got.ids).tobytes()

    def _encoded(self, pieces: list[str], whole: np.ndarray) -> list[bytes]:
        got = list(map(self.pieces.get, pieces))
        missing = [i for i, ids in enumerate(got) if ids is None]
        if missing:
            if len(self.pieces) + len(missing) > CACHE_PIECES:
                self.pieces.clear()
            self._learn([pieces[i] for i in missing], whole[missing].tolist())
            for i in missing:
                got[i] = self.pieces[pieces[i]]
        return got

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and where each text's ids begin (one more at the end)."""
        codes, vocabulary, at = C.coded_words(text)
        if not len(codes):
            return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
        pieces, uncut, pieces_at = cut_words(vocabulary)
        coded = pieces.dictionary_encode()
        whole = np.zeros(len(coded.dictionary), bool)
        whole[coded.indices.to_numpy()[uncut]] = True
        known = pa.array(self._encoded(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), whole), pa.large_binary())
        spelt, ends = _buffers(known.take(coded.indices))
        words = pa.Array.from_buffers(pa.large_binary(), len(vocabulary), [None, pa.py_buffer(ends[pieces_at]), spelt])
        ids, ends = _buffers(words.take(pa.array(codes)))
        return np.frombuffer(ids, np.uint32, ends[-1] // 4).astype("<u4", copy=False), ends[at] // 4


def _buffers(array: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a large binary array that was just made, and where each row begins in them (one more at the end)."""
    return array.buffers()[2], np.frombuffer(array.buffers()[1], np.int64, len(array) + 1)


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each file and Python process, so that a worker's tasks share its cache."""
    return WordTokenizer(path)

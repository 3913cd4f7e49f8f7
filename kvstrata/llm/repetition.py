"""Quality rule on repetition inside a text, from a suffix array over its words.

A slice of documents gets one suffix array by prefix doubling (word numbers are made unique to
each document, so no suffix matches across documents). Its longest-common-prefix (LCP) intervals
are the repeated word strings; an interval whose occurrences differ in the word before them is a
maximal repeat. The union of the spans of all maximal repeats gives the covered words; the longest
of them is the longest repeat.

Only suffixes that still tie are sorted again, so ordinary prose costs two or three sorts.
Defined cases: a null or empty text has no words and fails the base rule; a text may be of any
length (it is handled whole); equal rows give equal results; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Base rule: windows of this many words, found twice or more.
BASE_WINDOW = 8
MIN_WORDS = 20
BASE_PERCENT = 30
#: Shorter repeats are so many that looking at all of them says little.
LEAST_REPEAT = 4

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_IN_WORD = np.ones(256, np.int8)
_IN_WORD[list(b" \t\n\v\f\r")] = 0
_IN_WORD[0x80:0xC0] = 0  # continuation bytes: a code point counts once


def suffix_array(key: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for each j the ranks by the first 2**j words.

    key: a number per word that differs between documents; ends: per word, its document's end.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 1
    while len(tied):
        pos = order[tied]
        after = pos + step
        second = np.where(after < ends[pos], rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[pos] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        pos, pair = pos[by], pair[by]
        order[tied] = pos
        new = np.ones(len(pos), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[pos] = tied[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
        levels.append(rank.astype(np.int32))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray, least: int) -> np.ndarray:
    """LCP in words of each suffix with the one before it in order; 0 where it is below `least`."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    floor = least.bit_length() - 1
    if n < 2 or len(levels) <= floor:
        return lcp
    at = np.flatnonzero(levels[floor][order[1:]] == levels[floor][order[:-1]]) + 1
    x, y = order[at - 1].copy(), order[at].copy()
    long = np.zeros(len(at), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        inside = (x < n) & (y < n)
        a, b = np.minimum(x, n - 1), np.minimum(y, n - 1)
        same = inside & (levels[j][a] == levels[j][b]) & (x < ends[order[at - 1]]) & (y < ends[order[at]])
        add = same.astype(np.int64) << j
        long += add
        x += add
        y += add
    lcp[at] = np.where(long >= least, long, 0)
    return lcp


def lcp_intervals(order: np.ndarray, lcp: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(length, first, last, maximal) of every LCP interval, order[first..last] being its occurrences.

    before: a number for the word in front of each suffix, unique where there is none.
    """
    inside = lcp > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), [*edges[1::2].tolist(), len(lcp)][: len(edges[::2])]):
        heights = lcp[a:b].tolist()
        fronts = before[order[a - 1 : b]].tolist()
        stack: list[list[int]] = []  # length, first, lowest front, highest front
        for i, height in enumerate([*heights, 0]):
            first, low, high = a - 1 + i, fronts[i], fronts[i]
            while stack and stack[-1][0] > height:
                size, left, lo, hi = stack.pop()
                lo, hi = min(lo, low), max(hi, high)
                yield size, left, a - 1 + i, lo != hi
                first, low, high = left, lo, hi
            if not height:
                continue
            if stack and stack[-1][0] == height:
                stack[-1][2], stack[-1][3] = min(stack[-1][2], low), max(stack[-1][3], high)
            else:
                stack.append([height, first, low, high])


def maximal_repeats_at(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Per word, the length of the longest maximal repeat (of `least` words or more) that starts there; (length, first, last) of all.

    An interval comes after those inside it, which are longer, so it concerns only the suffixes that
    they left: each suffix is taken once, however deep the intervals are nested.
    """
    found, taken, sizes = [], [], []
    free: dict[int, int] = {}

    def left(i: int) -> int:
        to = i
        while to in free:
            to = free[to]
        while i != to:
            free[i], i = to, free[i]
        return to

    for size, a, b, full in lcp_intervals(order, lcp, before):
        if not full or size < least:
            continue
        found.append((size, a, b))
        i = left(a)
        while i <= b:
            taken.append(i)
            sizes.append(size)
            free[i] = i + 1
            i = left(i + 1)
    longest = np.zeros(len(order), np.int64)
    longest[order[taken]] = sizes
    return longest, found


def covered(longest: np.ndarray) -> np.ndarray:
    """Which words the spans (start, start + longest[start]) cover."""
    n = len(longest)
    at = np.flatnonzero(longest)
    depth = np.bincount(at, minlength=n + 1) - np.bincount(at + longest[at], minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def repeated_windows(order: np.ndarray, lcp: np.ndarray, width: int) -> np.ndarray:
    """Which words are in windows of `width` words found twice or more."""
    n = len(order)
    twice = np.zeros(n, np.int64)
    twice[order] = np.where(np.maximum(lcp[:n], lcp[1 : n + 1]) >= width, width, 0)
    return covered(twice)


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def measure(batch: pa.RecordBatch, least: int) -> dict[str, np.ndarray]:
    text = C.plain(batch.column("text"))
    ids, vocabulary, at = C.coded_words(text)
    n, count = len(ids), np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    ends = at[1:][doc]
    key = doc.astype(np.int64) * max(len(vocabulary), 1) + ids
    order, levels = suffix_array(key, ends)
    lcp = common_prefixes(order, levels, ends, min(least, BASE_WINDOW))
    before = np.empty(n, np.int64)
    before[1:] = key[:-1]
    starts = at[:-1][count > 0]
    before[starts] = -1 - np.arange(len(starts))
    longest, found = maximal_repeats_at(order, lcp, before, least)
    top = np.zeros(len(count), np.int64)
    hit = np.flatnonzero(longest)
    np.maximum.at(top, doc[hit], longest[hit])
    data, begin = C.byte_data(text)
    return {
        "n_words": count,
        "word_chars": C.sums_at(_IN_WORD[data], begin),
        "n_symbols": C.sums_at(_SYMBOL[data], begin),
        "n_dup_lines": np.array([repeated_lines(x) for x in text.to_pylist()], np.int64),
        "n_repeat_words": C.sums_at(repeated_windows(order, lcp, BASE_WINDOW), at),
        "covered_words": C.sums_at(covered(longest), at),
        "longest_repeat": top,
        "n_maximal_repeats": np.bincount(doc[order[[a for _, a, _ in found]]], minlength=len(count)),
    }


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_maximal_repeats"]


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 5, max_covered_percent: int = 40, max_longest: int = 60) -> DataFrame:
    """One row per input row: counts, base_failed, repeat_failed and kept.

    min_repeat: fewest words of a repeat (4 or more); repeat_failed: such repeats cover more than
    max_covered_percent of the words, or the longest has over max_longest words. Map-only: no shuffle.
    """
    if min_repeat < LEAST_REPEAT:
        raise ValueError(f"min_repeat must be {LEAST_REPEAT} or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            got = measure(batch, min_repeat)
            words = got["n_words"]
            failed = (words < MIN_WORDS) | (100 * got["n_repeat_words"] > BASE_PERCENT * words)
            rule = (100 * got["covered_words"] > max_covered_percent * words) | (got["longest_repeat"] > max_longest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[c], pa.int64()) for c in COLUMNS), pa.array(failed), pa.array(rule), pa.array(~failed & ~rule)], names=["doc_id", *COLUMNS, "base_failed", "repeat_failed", "kept"])

    schema = f"doc_id {C.id_type(df, id_col)}, " + ", ".join(f"{c} bigint" for c in COLUMNS) + ", base_failed boolean, repeat_failed boolean, kept boolean"
    return C.id_text(df, id_col, text_col).mapInArrow(run, schema)


def maximal_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 5) -> DataFrame:
    """One row per document and maximal repeat: its length in words, how often it occurs, its first word's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            ids, vocabulary, at = C.coded_words(batch.column("text"))
            count = np.diff(at)
            doc = np.repeat(np.arange(len(count)), count)
            key = doc.astype(np.int64) * max(len(vocabulary), 1) + ids
            order, levels = suffix_array(key, at[1:][doc])
            lcp = common_prefixes(order, levels, at[1:][doc], min_repeat)
            before = np.empty(len(ids), np.int64)
            before[1:] = key[:-1]
            starts = at[:-1][count > 0]
            before[starts] = -1 - np.arange(len(starts))
            _, found = maximal_repeats_at(order, lcp, before, min_repeat)
            rows = [(int(doc[order[a]]), size, b - a + 1, int(order[a : b + 1].min() - at[doc[order[a]]])) for size, a, b in found]
            number = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(number), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))], names=["doc_id", "n_words", "n_occurrences", "first_word"])

    return C.id_text(df, id_col, text_col).mapInArrow(run, f"doc_id {C.id_type(df, id_col)}, n_words bigint, n_occurrences bigint, first_word bigint")

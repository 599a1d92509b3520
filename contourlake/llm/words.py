"""Word and shingle hashes of whole Arrow text columns in numpy, without a Python object for each word.

A word is a run of letters and digits; A-Z count as a-z, and every byte of a
character beyond ASCII counts as a letter. Texts of any length go through in
pieces that end between words.
"""

from __future__ import annotations

import numpy as np

from .common import PIECE, mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            _POWERS = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            _INVERSE = np.cumprod(steps, dtype=np.uint64)
    return _POWERS, _INVERSE


def _cut(data: np.ndarray, begin: int, end: int) -> int:
    """Where the piece from begin may end: between words, near PIECE bytes on."""
    at = begin + PIECE
    if at >= end:
        return end
    gaps = np.flatnonzero(~_WORD[data[max(begin, at - 4096) : at]])
    if len(gaps):
        return max(begin, at - 4096) + int(gaps[-1]) + 1
    while at < end:
        gaps = np.flatnonzero(~_WORD[data[at : at + PIECE]])
        if len(gaps):
            return at + int(gaps[0]) + 1
        at += PIECE
    return end


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """A 64-bit hash of each word in order, and where each row's words begin (with the end of the last).

    With `prefixes`, also one array for each length: the hash of the word's
    first so many bytes, 0 for words that are not longer.
    """
    parts, where, begin, end = [], [], 0, len(data)
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    while begin < end:
        stop = _cut(data, begin, end)
        piece = data[begin:stop]
        word = _WORD[piece]
        first = np.zeros(len(piece) + 1, bool)
        first[0] = first[-1] = True
        inside = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, stop)]
        first[inside - begin] = True
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        starts = np.flatnonzero(word & (~before | first[:-1]))
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        ends = np.flatnonzero(word & (~after | first[1:])) + 1
        power, inverse = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((_LOWER[piece].astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=sums[1:])
        parts.append(mix64((sums[ends] - sums[starts]) * inverse[starts]))
        for k, found in zip(prefixes, heads, strict=True):
            longer = ends - starts > k
            at = starts[longer]
            own = np.zeros(len(starts), np.uint64)
            own[longer] = mix64((sums[at + k] - sums[at]) * inverse[at] + np.uint64(k))
            found.append(own)
        where.append(starts + begin)
        begin = stop
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    positions = np.concatenate(where) if where else np.zeros(0, np.int64)
    if prefixes:
        return hashes, np.searchsorted(positions, offsets), [np.concatenate(x) if x else hashes for x in heads]
    return hashes, np.searchsorted(positions, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words; of all words where there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x100000001B3) + words[k : n - size + 1 + k]
    return mix64(out)


def weighted_shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and how often each occurs."""
    return np.unique(shingle_hashes(words, size), return_counts=True)


def rows_of_shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of all rows of a piece at once: what weighted_shingles gives for each, in the order of rows and shingles."""
    n = np.diff(at)
    hashes, owner = [], []
    if len(words) >= size:
        whole = shingle_hashes(words, size)
        row = np.repeat(np.arange(len(n)), n)[: len(whole)]
        inside = np.arange(len(whole)) + size <= at[1:][row]
        hashes.append(whole[inside])
        owner.append(row[inside])
    for k in np.flatnonzero((n > 0) & (n < size)).tolist():
        hashes.append(shingle_hashes(words[at[k] : at[k + 1]], size))
        owner.append(np.array([k]))
    if not hashes:
        return np.zeros(0, np.int64), words[:0], np.zeros(0, np.int64)
    found, row = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (row[1:] != row[:-1]))))
    return row[first], found[first], np.diff(np.append(first, len(found)))

"""Passes over long sequences, piece by piece. Pure numpy, no Spark; each pass is linear in the sequence's length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def kmer_ids(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the length - k k-mers (the last one does not count), equal for equal k-mers, and for each: it holds no n."""
    n = len(letters) - k
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    used = np.zeros(256, bool)
    used[letters] = True
    small = (np.cumsum(used) - 1)[letters].astype(np.uint64)
    bits = max(1, int(used.sum() - 1).bit_length())
    ids = np.zeros(n, np.uint64)
    width = 0
    if bits * k <= 40:  # by words of 1, 2, 4, ... letters, those of which k is the sum
        word, size, at = small, 1, 0
        while True:
            if k & size:
                ids = (ids << np.uint64(bits * size)) | word[at : at + n]
                at += size
            if 2 * size > k:
                break
            word = (word[: len(word) - size] << np.uint64(bits * size)) | word[size:]
            size *= 2
    else:
        for j in range(k):
            if width + bits > 40:  # renumber, so that ids stay small
                ids = np.unique(ids, return_inverse=True)[1].astype(np.uint64)
                width = int(ids.max()).bit_length()
            ids = (ids << np.uint64(bits)) | small[j : j + n]
            width += bits
    bad = np.concatenate([[0], np.cumsum(letters == ord("n"))])
    return ids.astype(np.int64), bad[k : k + n] == bad[:n]


def pieces(text: str, step: int, beyond: int) -> Iterator[tuple[int, str]]:
    """(start from 0, text) of pieces of step characters and so many beyond, cut once."""
    for a in range(0, len(text), step):
        yield a, text[a : a + step + beyond]


def window_count(length: int, size: int) -> int:
    """Windows of a sequence: the last begins before length - size; none for a sequence shorter than one."""
    return max(1, -(-(length - size) // size)) if length >= size else 0


def window_totals(text: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of size: k-mers without n, and those that occur once in it."""
    number = window_count(len(text), size)
    total, single = np.zeros(number, np.int64), np.zeros(number, np.int64)
    each = max(1, PIECE // size)
    for first in range(0, number, each):
        own = min(each, number - first)
        ids, clear = kmer_ids(codes(text[first * size : (first + own) * size]), k)
        at = np.arange(len(ids))
        use = clear & (at % size < size - k)  # within one window, and not its last
        if not use.any():
            continue
        width = int(ids.max()).bit_length()  # 42 at most, and a window's number has 21 at most
        both = np.sort((at[use] // size) << width | ids[use])
        new = np.concatenate([[True], both[1:] != both[:-1], [True]])
        window = both >> width
        total[first : first + own] = np.bincount(window, minlength=own)
        single[first : first + own] = np.bincount(window[new[1:] & new[:-1]], minlength=own)
    return total, single


def kmer_places(text: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """For each piece: places (from 0, in the piece) of its k-mers without n sorted by (k-mer, place), their ids, and the piece."""
    for a, part in pieces(text, PIECE, k):
        ids, clear = kmer_ids(codes(part), k)
        at = np.flatnonzero(clear)
        order = np.argsort(ids[at], kind="stable")
        yield a, at[order], ids[at[order]], part


def next_distances(text: str, k: int, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, str]]:
    """For each piece: its start, places in it (from 0) and distances to the next occurrence of the same k-mer, where it is from least to most."""
    for a, part in pieces(text, PIECE, k + most):
        ids, clear = kmer_ids(codes(part), k)
        at = np.flatnonzero(clear)
        order = np.argsort(ids[at], kind="stable")
        at, ids = at[order], ids[at[order]]
        gap = at[1:] - at[:-1]
        use = (ids[1:] == ids[:-1]) & (gap >= least) & (gap <= most) & (at[:-1] < PIECE)
        yield a, at[:-1][use], gap[use], part


def hamming_places(text: str, pattern: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts (from 0) of all places where pattern fits with at most that many mismatches, and these."""
    p = codes(pattern)
    for a, part in pieces(text, PIECE, len(p) - 1):
        t = codes(part)
        n = len(t) - len(p) + 1
        if n > 0:
            misses = np.zeros(n, np.int16)
            for j, c in enumerate(p.tolist()):
                misses += t[j : j + n] != c
            hit = np.flatnonzero(misses <= most)
            yield a + hit, misses[hit].astype(np.int64)

"""Columnar text segmentation: whole blocks of documents as code-point arrays.

A block holds some documents' texts end to end. Segmenters return token starts and ends in code points; each token
gets a 64-bit hash, so that work on tokens is done once for each distinct token of a block, and Memo keeps results
across blocks; the hash only finds a token's entry, its characters decide. Memory is bounded by BLOCK characters (or one longer document) and Memo's capacity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1_000_000
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_kept: list[np.ndarray] = [np.zeros(0, np.uint64)]


def _weights(n: int) -> np.ndarray:
    """A pseudo-random 64-bit weight for each place in a token. Not powers of one base, under which whole families of texts fall together."""
    if len(_kept[0]) >= n:
        return _kept[0][:n]
    out = mix(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if n <= BLOCK:  # not kept for one very long text
        _kept[0] = out
    return out[:n]


def spread(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans laid end to end: each character's place in its span, its place in the text, and where the spans begin (and end)."""
    marks = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=marks[1:])
    every = np.arange(int(marks[-1]))
    place = every - np.repeat(marks[:-1], lens)
    return place, place + np.repeat(starts, lens), marks


def letters(cps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters at these ascending places; spans that cover the whole text need no look-up."""
    return cps if len(at) == len(cps) and (not len(at) or at[0] == 0 and at[-1] == len(cps) - 1) else cps[at]


class Block:
    """text: the documents' texts end to end; cps: its code points; bounds: each document's start, and the end."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.cps = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.bounds[1:])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, cps: np.ndarray | None = None, heads: tuple[int, ...] = (), where=None):
        """64-bit hashes of the spans' code points (a sum of characters times random weights by place); cps stands in for the
        block's own (say, lower-cased); where is spread() of the spans, if known. With heads: a list of these and of the hashes of each span's first so many characters."""
        cps, lens = self.cps if cps is None else cps, ends - starts
        place, at, marks = where or spread(starts, lens)
        h = (letters(cps, at).astype(np.uint64) + np.uint64(1)) * _M3
        h ^= h >> np.uint64(29)
        h *= _weights(int(lens.max()) if len(lens) else 0)[place]
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h, out=sums[1:])
        out = [mix(sums[marks[:-1] + n] - sums[marks[:-1]] + n.astype(np.uint64) * _M2) for n in (lens, *(np.minimum(lens, k) for k in heads))]
        return out if heads else out[0]

    def offsets(self, starts: np.ndarray) -> np.ndarray:
        """For sorted token starts: each document's first token, and the number of tokens."""
        return np.searchsorted(starts, self.bounds)


def blocks(texts: Iterable[str | None], size: int = BLOCK, prefix: str = "") -> Iterator[Block]:
    """Blocks of whole documents in order; a null is an empty text. prefix goes before each text."""
    held, n = [], 0
    for t in texts:
        t = prefix + (t or "")
        if held and n + len(t) > size:
            yield Block(held)
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield Block(held)


def texts(column) -> Iterator[str | None]:
    """An Arrow column's values, a few rows at a time."""
    for a in range(0, len(column), 256):
        yield from column.slice(a, 256).to_pylist()


def runs(block: Block, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one class within a document."""
    n = len(cls)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    b = block.bounds[:-1]
    new[b[b < n]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def spans_of(block: Block, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs within documents whose characters are members."""
    starts, ends = runs(block, member)
    keep = member[starts] if len(starts) else np.zeros(0, bool)
    return starts[keep], ends[keep]


L, N, S, O = 1, 2, 3, 0


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, white space or other, by code point, as the tokenizer library's own character tables have them:
    an encoder of single bytes, whose pattern is one class, gives back just the characters of that class."""
    import tiktoken

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (S, r"\s+")):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[[ord(c) for c in bytes(only.encode_ordinary(every)).decode()]] = kind
    return table


def split_gpt2(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Token starts and ends as the public byte-level pattern (contractions, then an optional space with letters, numbers or others, then white space) splits each document.

    A run of white space before other text gives up its last character: a space joins the next token, anything else
    stands alone. A lone apostrophe that no space joins, before s t re ve m ll d, takes those letters.
    """
    cps, cls = block.cps, classes()[block.cps]
    starts, ends = runs(block, cls)
    if not len(starts):
        return starts, ends
    kind = cls[starts]
    last = np.zeros(len(starts), bool)  # of its document
    last[:-1] = np.isin(starts[1:], block.bounds)
    last[-1] = True
    cut = np.zeros(len(cps) + 1, bool)
    cut[starts] = True
    sp = np.flatnonzero((kind == S) & ~last)
    tail = ends[sp] - 1
    cut[tail] = True
    joins = cps[tail] == 32
    cut[ends[sp][joins]] = False
    # contractions
    one = np.flatnonzero((kind == O) & ~last & (ends - starts == 1) & (cps[starts] == 39))
    if len(one):
        at = starts[one]
        free = cut[at] & (kind[np.minimum(one + 1, len(kind) - 1)] == L)
        one, at = one[free], at[free]
        first = cps[at + 1]
        single = (first == 115) | (first == 116) | (first == 109) | (first == 100)
        second = np.where(ends[one + 1] - at > 2, cps[np.minimum(at + 2, len(cps) - 1)], 0)
        double = ((first == 114) & (second == 101)) | ((first == 118) & (second == 101)) | ((first == 108) & (second == 108))
        hit = single | double
        at, width = at[hit], np.where(single, 1, 2)[hit]
        cut[at + 1] = False
        cut[at + 1 + width] = True
    out = np.flatnonzero(cut[:-1])
    return out, np.append(out[1:], len(cps))


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case by code point; characters whose lower case is several stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1E944):  # no cased character lies above
        low = chr(i).lower() if not 0xD800 <= i < 0xE000 else ""
        if len(low) == 1:
            table[i] = ord(low)
    return table


def letter_words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and the lower-cased code points."""
    starts, ends = spans_of(block, classes()[block.cps] == L)
    return starts, ends, lower_table()[block.cps]


class Memo:
    """Results by token, across blocks. compute(words) gives the flat values of all words and each word's number of values.
    Tokens are looked up by hash and then compared character by character with the token that the entry was made for; those
    that only share its hash are looked up by their text. It empties itself beyond capacity entries (or TEXT characters of
    them), so memory is bounded by these and by one block."""

    TEXT = 8_000_000

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, capacity: int = 500_000):
        self.compute, self.dtype, self.capacity = compute, dtype, capacity
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64)] * 2
        self.ids = [np.zeros(0, np.int64)] * 2
        self.n = 0
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, self.dtype), 0
        self.text, self.written = np.zeros(4096, np.uint32), 0
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.odd: dict[str, int] = {}

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, len(a) * 3 // 2), a.dtype)
        out[: len(a)] = a
        return out

    def _add(self, words: list[str]) -> np.ndarray:
        """New entries for these words."""
        flat, lens = self.compute(words)
        n, used = self.n + len(words), self.used + len(flat)
        self.starts, self.lens, self.flat = self._room(self.starts, n), self._room(self.lens, n), self._room(self.flat, used)
        self.lens[self.n : n] = lens
        self.starts[self.n : n] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : used] = flat
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        self.begin, self.size, self.text = self._room(self.begin, n), self._room(self.size, n), self._room(self.text, self.written + len(chars))
        self.size[self.n : n] = size
        self.begin[self.n : n] = self.written + np.cumsum(size) - size
        self.text[self.written : self.written + len(chars)] = chars
        new = np.arange(self.n, n)
        self.n, self.used, self.written = n, used, self.written + len(chars)
        return new

    def lookup(self, uniq: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """uniq: sorted distinct hashes; words(i) gives the tokens at positions i of uniq."""
        out = np.full(len(uniq), -1, np.int64)
        for keys, ids in zip(self.keys, self.ids):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
                hit = keys[at] == uniq
                out[hit] = ids[at[hit]]
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new = self._add(words(miss))
            out[miss] = new
            k, i = np.concatenate([self.keys[1], uniq[miss]]), np.concatenate([self.ids[1], new])
            if len(k) > 60_000:
                k, i = np.concatenate([self.keys[0], k]), np.concatenate([self.ids[0], i])
                o = np.argsort(k)
                self.keys, self.ids = [k[o], np.zeros(0, np.uint64)], [i[o], np.zeros(0, np.int64)]
            else:
                o = np.argsort(k)
                self.keys[1], self.ids[1] = k[o], i[o]
        return out

    def of_tokens(self, block: Block, starts: np.ndarray, ends: np.ndarray, cps: np.ndarray | None = None) -> np.ndarray:
        """The memo's index for each token; cps stands in for the block's own characters."""
        if self.n > self.capacity or self.written > self.TEXT:
            self.clear()
        if cps is None:
            cps, text = block.cps, block.text
        else:
            text = cps.tobytes().decode("utf-32-le", "surrogatepass")
        words = lambda i: [text[a:b] for a, b in zip(starts[i].tolist(), ends[i].tolist())]
        lens = ends - starts
        where = spread(starts, lens)
        uniq, first, inv = np.unique(block.hashes(starts, ends, cps, where=where), return_index=True, return_inverse=True)
        index = self.lookup(uniq, lambda i: words(first[i]))[inv]
        other = np.flatnonzero(self.size[index] != lens)
        shared = lens
        if len(other):
            shared = np.minimum(self.size[index], lens)
            where = spread(starts, shared)
        place, at, marks = where
        differ = letters(cps, at) != self.text[place + np.repeat(self.begin[index], shared)]
        if differ.any():
            other = np.union1d(other, np.searchsorted(marks, np.flatnonzero(differ), side="right") - 1)
        for i, word in zip(other.tolist(), words(other)):
            if word not in self.odd:
                self.odd[word] = int(self._add([word])[0])
            index[i] = self.odd[word]
        return index

    def expand(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the indexed entries end to end, and each one's number."""
        lens = self.lens[index].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[index] - (ends - lens), lens) + np.arange(total)
        return self.flat[at], lens


def doc_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each document's values; offsets as Block.offsets gives them."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]

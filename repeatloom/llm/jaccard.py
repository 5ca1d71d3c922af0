"""N-gram Jaccard self-join by prefix trees, to connected components.

1. Each text becomes its set of five-word shingles, hashed to 64 bits; the set has a 128-bit key, so equal sets are one
   item and copies are never compared. The same pass names the shingles that a good share of some run of sets has; the
   HOTTEST of them with the greatest counts, a table of fixed size, are common: every set may use them, and they are not dealt.
2. The other shingles (and each set's key, so that one run alone goes on with a set) are dealt by hash range to count in how many sets each occurs, one range a task. A shingle is of use
   only if it also occurs in a set of a size that can reach the threshold with this one; the answer goes back to the run
   of sets (flush) that asked. Useless shingles count in the set's size alone.
3. Items whose useful shingles are too few to reach the threshold are alone. The others order their shingles globally:
   by number of sets (in quarter octaves; common ones last), then hash. An item's shingle is a 64-bit code: 8 bits of
   rank, 56 of hash. Two items that link share one of the first size - ceil(t * size) + 1 codes.
4. Comparing a group of items: items are blocked by size and hash, and only blocks of sizes that can link meet. In such a
   cell one block's sets are stored in a prefix tree in the global order, common shingles first, so shared beginnings are
   stored and counted once. The other block's items go down it together: at an edge each gains its overlap with the
   edge's shingles, and drops out of the subtree when the overlap so far plus the most that can remain is below what a
   link needs, when no size below it can link, or when all items below are known to be connected with it.
5. Each item first meets others at the least item with which it shares a prefix shingle (its hub), in blocks that hold
   the hub too, so that large groups of near copies become one component early. A prefix shingle all of whose items are in
   one component is closed. What is left is exact: the items of every open shingle are compared as a group of their own
   (shingles with the same items once), or all open items of a family (chained by open shingles) as one, whichever moves less.
6. Links of a cell are reduced to stars; components of all stars are the result.

No pair is dropped: there is no cap on partners, candidates or groups; m items that share a shingle and do not link take at
most (m / BLOCK)^2 / 2 cells, dealt over all tasks. Nothing of the corpus but the fixed table of common shingles is collected
on the driver. A cell holds at most two blocks of BLOCK items or about CELL shingles, but at least two items: memory follows
the longest two texts that may link, not the groups.

Null text, and texts without words, have no shingles: size 0, linked with nothing, component_id their own id. Texts of one
to four words have one shingle, the whole sequence. Null ids: the component of a null id alone is null. Rows that
repeat an id or text keep their rows. Other columns are not read. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.llm import common, graph, vectext

WORDS, NUM, DEN = 5, 75, 100
BLOCK, CELL = 128, 400_000  # items of a block, shingles of a block
OFTEN = 16  # rows an item in the exact comparison before families are looked at
FLUSH = 600_000  # shingles of a run of sets
PART = 1_000_000  # shingles of a range
TEXT = 400_000  # characters taken up at once
SHARE, HOTTEST = 128, 100_000  # common: in one of so many sets of some run; at most so many

_SALT = np.uint64(0xA0761D6478BD642F)
_HASH = np.uint64((1 << 56) - 1)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(128, dtype=np.uint32)
    lower[65:91] += 32
    space = np.zeros(128, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return lower, space


def shingles(block: vectext.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order end to end, the documents' bounds in them, and 128-bit set keys (two columns)."""
    lower, space = _tables()
    cps = block.cps.copy()
    ascii_ = cps < 128
    cps[ascii_] = lower[cps[ascii_]]
    word = np.ones(len(cps), bool)
    word[ascii_] = ~space[cps[ascii_]]
    starts, ends = vectext.spans_of(block, word)
    w = block.hashes(starts, ends, cps)
    at = np.searchsorted(starts, block.bounds)
    m = np.uint64(0x9FB21C651E98DF25)
    if len(w) >= WORDS:
        h = w[: len(w) - WORDS + 1]
        for k in range(1, WORDS):
            h = vectext.mix(h * m + w[k : len(w) - WORDS + 1 + k])
    else:
        h = np.zeros(0, np.uint64)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(h[a : b - WORDS + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = vectext.mix(x * m + w[k])
            sets.append(x)
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    size = np.diff(bounds).astype(np.uint64)
    keys = [vectext.mix(vectext.doc_sums(vectext.mix(flat * m ^ salt), bounds) + size) for salt in (m, _SALT)]
    return flat, bounds, np.stack(keys, axis=1)


class Run:
    """Distinct sets of some documents, held until they have FLUSH shingles."""

    def __init__(self):
        self.tokens, self.keys, self.sizes, self.seen, self.n = [], [], [], set(), 0

    def add(self, flat: np.ndarray, bounds: np.ndarray, keys: np.ndarray) -> None:
        sizes = np.diff(bounds)
        fresh = np.zeros(len(keys), bool)
        for i, k in enumerate(map(tuple, keys.tolist())):
            if sizes[i] and k not in self.seen:
                fresh[i] = True
                self.seen.add(k)
        self.tokens.append(flat[np.repeat(fresh, sizes)])
        self.keys.append(keys[fresh])
        self.sizes.append(sizes[fresh])
        self.n += len(self.tokens[-1])

    @property
    def full(self) -> bool:
        return self.n >= FLUSH or len(self.seen) > 60_000  # sets of a run are numbered in 16 bits

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.concatenate(self.tokens), np.concatenate(self.keys), np.concatenate(self.sizes)
        self.__init__()
        return out


def _runs(blocks: Iterator[vectext.Block]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shingles, keys, sizes) of runs of distinct sets; a block of more sets than a run numbers is cut."""
    run = Run()
    for block in blocks:
        flat, bounds, keys = shingles(block)
        for a in range(0, len(keys), 4000):
            b = min(a + 4000, len(keys))
            run.add(flat[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], keys[a:b])
            if run.full:
                yield run.take()
    if run.n:
        yield run.take()


def _members(df: DataFrame, text: str, id: str) -> DataFrame:
    """id, k1, k2 (the set's key), n_shingles; and rows (token, n) for shingles that n sets of a run have, one in SHARE at least."""
    names = ["id", "k1", "k2", "n_shingles", "token", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = Run(), None

        def common_ones() -> pa.RecordBatch:
            tokens, _, sizes = held.take()
            t, n = np.unique(tokens, return_counts=True)
            often = n >= max(4, -(-len(sizes) // SHARE))
            return pa.RecordBatch.from_arrays([pa.nulls(int(often.sum()), kind), *[pa.nulls(int(often.sum()), pa.int64())] * 3, pa.array(t[often].view(np.int64)), pa.array(n[often])], names=names)

        for b in batches:
            at, kind = 0, b.schema.field(0).type
            for block in vectext.blocks(vectext.texts(b.column(1)), TEXT):
                flat, bounds, keys = shingles(block)
                k = keys.view(np.int64)
                nothing = pa.nulls(len(block), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(block)), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(np.diff(bounds)), nothing, nothing], names=names)
                at += len(block)
                held.add(flat, bounds, keys)
                if held.full:
                    yield common_ones()
        if held.n:
            yield common_ones()

    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[text]).mapInArrow(common.tidy(run), f"id {kind}, k1 long, k2 long, n_shingles long, token long, n long")


def set_keys(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, k1, k2, n_shingles."""
    return _members(df, text, id).where("token is null").drop("token", "n")


_ENTRY = np.dtype([("token", "<u8"), ("set", "<u8"), ("size", "u1"), ("number", "<u2")])
_REPLY = np.dtype([("code", "<u8"), ("number", "<u2")])
_SET = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("size", "<i8")])


_WIDTH = {"token": 7, "set": 6}  # bytes kept of these: two different sets are taken for one with a chance of 2^-48


def _width(kind: np.dtype, name: str) -> int:
    return _WIDTH.get(name, kind[name].itemsize)


def _dump(x: np.ndarray) -> bytes:
    """Column after column: alike values lie together, which the shuffle's compression uses."""
    out = []
    for c in x.dtype.names:
        raw = np.ascontiguousarray(x[c]).view(np.uint8).reshape(len(x), -1)
        out.append(np.ascontiguousarray(raw[:, : _width(x.dtype, c)]).tobytes())
    return b"".join(out)


def _load(raw: memoryview, kind: np.dtype) -> np.ndarray:
    n = len(raw) // sum(_width(kind, c) for c in kind.names)
    out, at = np.zeros(n, kind), 0
    for c in kind.names:
        w, full = _width(kind, c), np.zeros((n, kind[c].itemsize), np.uint8)
        full[:, :w] = np.frombuffer(raw, np.uint8, n * w, at).reshape(n, w)
        out[c] = full.view(kind[c]).ravel()
        at += n * w
    return out


def _band(size: np.ndarray) -> np.ndarray:
    """Sizes that can link are in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / math.log(DEN / NUM) + 1e-9).astype(np.int64)


def _near(a, b):
    return abs(a - b) <= 1


def _rank(count: np.ndarray) -> np.ndarray:
    """The number of sets in quarter octaves; 255 is left to the common shingles."""
    return np.minimum(254, np.floor(4 * np.log2(np.maximum(count, 1)) + 1e-9)).astype(np.uint64)


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["part", "flush", "kind", "packed"])


_ROWS = "part int, flush long, kind int, packed binary"
_KEY = 255  # instead of a size band: the entry is a set's key
_ASK, _SETS, _ALL = 0, 1, 2  # kinds of rows: shingles of one range; a run's sets; its sets' common shingles


def _dealt(df: DataFrame, text: str, parts: int, hot) -> DataFrame:
    """Rows for each run of sets: its shingles by hash range (part), and to one part its sets and their common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, frequent = TaskContext.get().partitionId() << 32, hot.value
        blocks = (block for b in batches for block in vectext.blocks(vectext.texts(b.column(0)), TEXT))
        for tokens, keys, sizes in _runs(blocks):
            number = np.repeat(np.arange(len(keys)), sizes)
            head = np.empty(len(keys), _SET)
            head["k1"], head["k2"], head["size"] = keys[:, 0].view(np.int64), keys[:, 1].view(np.int64), sizes
            rows = [(flush % parts, flush, _SETS, _dump(head))]
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                is_hot = frequent[at] == tokens
                if is_hot.any():
                    every = np.empty(int(is_hot.sum()), _REPLY)
                    every["code"], every["number"] = np.uint64(255 << 56) | tokens[is_hot] & _HASH, number[is_hot]
                    rows.append((flush % parts, flush, _ALL, _dump(every)))
                    tokens, number = tokens[~is_hot], number[~is_hot]
            # and each set's second key, so that of the runs that hold it one is told to keep it
            tokens, number = np.concatenate([tokens, keys[:, 1]]), np.concatenate([number, np.arange(len(keys))])
            band = np.concatenate([np.minimum(_KEY - 1, _band(sizes))[number[: -len(keys)]], np.full(len(keys), _KEY)])
            part = (vectext.mix(tokens ^ _SALT) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, tokens, number, band = part[order], tokens[order], number[order], band[order]
            entry = np.empty(len(tokens), _ENTRY)
            entry["token"], entry["number"], entry["set"], entry["size"] = tokens, number, keys[number, 0], band
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
                rows.append((int(part[a]), flush, _ASK, _dump(entry[a:b])))
                if len(rows) == 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            flush += 1

    return df.select(df[text]).mapInArrow(common.tidy(run), _ROWS)


def _answer(entry: np.ndarray, flush: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flush, number, code) of the useful shingles; of a set that several runs hold, the first run alone is answered, and told
    so by a code of 0."""
    key = np.flatnonzero(entry["size"] == _KEY)
    key = key[np.lexsort((flush[key], entry["set"][key], entry["token"][key]))]
    e, f = entry[key], flush[key]
    first = np.ones(len(e), bool)
    first[1:] = (e["token"][1:] != e["token"][:-1]) | (e["set"][1:] != e["set"][:-1])
    kept = f[first], e["number"][first], np.zeros(int(first.sum()), np.uint64)
    own = entry["size"] != _KEY
    entry, flush = entry[own], flush[own]
    order = np.argsort(entry["token"], kind="stable")
    t = entry["token"][order]
    same = t[1:] == t[:-1]
    several = np.zeros(len(t), bool)
    several[1:] |= same
    several[:-1] |= same
    order = order[several]  # shingles of one set only are most of all
    e, f = entry[order], flush[order]
    order = np.lexsort((e["number"], f, e["set"], e["token"]))
    e, f = e[order], f[order]
    copy = np.zeros(len(e), bool)  # the same set, held by two runs
    copy[1:] = (e["token"][1:] == e["token"][:-1]) & (e["set"][1:] == e["set"][:-1])
    e, f = e[~copy], f[~copy]
    order = np.lexsort((e["size"], e["token"]))
    e, f = e[order], f[order]
    t, band = e["token"], e["size"].astype(np.int64)
    near = (t[1:] == t[:-1]) & _near(band[1:], band[:-1])
    use = np.zeros(len(e), bool)
    use[1:] |= near
    use[:-1] |= near
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(t)))
    code = _rank(np.repeat(count, count)) << np.uint64(56) | t & _HASH
    return tuple(np.concatenate([x, y]) for x, y in zip(kept, (f[use], e["number"][use], code[use])))


def _shared(dealt: DataFrame, parts: int) -> DataFrame:
    """flush, kind, packed: for each run its sets, its sets' common shingles, and the useful ones among the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, flushes = [], []
        for b in batches:
            for part, flush, kind, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if kind == _ASK:
                    entries.append(_load(memoryview(raw.as_buffer()), _ENTRY))
                    flushes.append(np.full(len(entries[-1]), flush))
                else:
                    yield _batch([(part, flush, kind, raw.as_py())])
        if entries:
            entry, flush = np.concatenate(entries), np.concatenate(flushes)
            del entries, flushes
            f, number, code = _answer(entry, flush)
            del entry, flush
            order = np.argsort(f, kind="stable")
            f, reply = f[order], np.empty(len(f), _REPLY)
            reply["code"], reply["number"] = code[order], number[order]
            cuts = np.flatnonzero(np.diff(f, prepend=-1))
            rows = [(0, int(f[a]), _ALL, _dump(reply[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(f)])]
            for a in range(0, len(rows), 256):
                yield _batch(rows[a : a + 256])

    return dealt.repartitionById(parts, F.col("part")).mapInArrow(common.tidy(run), _ROWS).drop("part")


def _items(shared: DataFrame, parts: int) -> DataFrame:
    """node (a number of the set), k1, k2, size, tokens (codes in the global order, rare first), prefix (how many of them); only items that can link at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, np.ndarray] = {}
        codes: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for flush, kind, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                view = memoryview(raw.as_buffer())
                if kind == _SETS:
                    heads[flush] = _load(view, _SET)
                else:
                    codes.setdefault(flush, []).append(_load(view, _REPLY))
        for flush in sorted(codes):
            head, x = heads[flush], np.concatenate(codes.pop(flush))
            x = x[np.lexsort((x["code"], x["number"]))]
            mine = np.zeros(len(head), bool)
            mine[x["number"][x["code"] == 0]] = True
            x = x[(x["code"] != 0) & mine[x["number"]]]
            n = np.bincount(x["number"], minlength=len(head))
            size = head["size"]
            able = n * DEN >= size * NUM
            able &= n > 0
            tokens, node = x["code"][np.repeat(able, n)].view(np.int64), (flush << 16) + np.flatnonzero(able)
            head, n, size = head[able], n[able], size[able]
            # shingles that no other set has come first of all, so this many useful ones are left in the prefix
            prefix = np.maximum(0, size - -(-NUM * size // DEN) + 1 - (size - n))
            bounds = np.concatenate([[0], np.cumsum(n)])
            for a in range(0, len(n), 1000):
                e = min(a + 1000, len(n))
                lists = pa.ListArray.from_arrays(pa.array(bounds[a : e + 1] - bounds[a], pa.int32()), pa.array(tokens[bounds[a] : bounds[e]]))
                yield pa.RecordBatch.from_arrays([pa.array(node[a:e]), pa.array(head["k1"][a:e]), pa.array(head["k2"][a:e]), pa.array(size[a:e]), lists, pa.array(prefix[a:e], pa.int32())], names=names)

    names = ["node", "k1", "k2", "size", "tokens", "prefix"]
    return shared.repartition(parts, "flush").mapInArrow(common.tidy(run), "node long, k1 long, k2 long, size long, tokens array<long>, prefix int")


def need(a, b):
    """The least intersection with which sets of sizes a and b link: 100 i >= 75 (a + b - i)."""
    return -(-NUM * (a + b) // (NUM + DEN))


class Tree:
    """A path-compressed prefix tree over sets of one order; each node: shingles on its edge, items that end there, sizes below,
    and the component of all items below (None where they differ)."""

    __slots__ = ("edge", "items", "children", "low", "high", "left", "known")

    def __init__(self, edge: np.ndarray):
        self.edge, self.items, self.children = edge, [], []

    @staticmethod
    def build(sets: list[np.ndarray], sizes: np.ndarray, known: np.ndarray) -> "Tree":
        """sets: shingles by their place in the one global order; they are sorted here, so a subtree is a run of neighbours."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())

        def grow(run: list[int], depth: int) -> "Tree":
            first, last = sets[run[0]], sets[run[-1]]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:n] != last[depth:n])
            stop = depth + int(differ[0]) if len(differ) else n
            node = Tree(first[depth:stop])
            k = 0
            while k < len(run) and len(sets[run[k]]) == stop:
                node.items.append(run[k])
                k += 1
            while k < len(run):
                j, here = k, sets[run[k]][stop]
                while j < len(run) and sets[run[j]][stop] == here:
                    j += 1
                node.children.append(grow(run[k:j], stop))
                k = j
            node.low, node.high = int(sizes[run].min()), int(sizes[run].max())
            node.left = max([0, *(len(c.edge) + c.left for c in node.children)])  # the most shingles that can follow
            node.known = int(known[run[0]]) if (known[run] == known[run[0]]).all() else None
            return node

        return grow(order, 0)


def links(tokens_a: list[np.ndarray], sizes_a: np.ndarray, tokens_b: list[np.ndarray], sizes_b: np.ndarray, known_a: np.ndarray | None = None, known_b: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """(item of a, items of b) that link. a is stored in the tree, b goes down it, as many items at once as memory for 30
    million (shingle, item) marks allows. Pairs of one known component need not be found."""
    known_a = np.arange(len(tokens_a)) if known_a is None else known_a
    known_b = -1 - np.arange(len(tokens_b)) if known_b is None else known_b
    every = np.unique(np.concatenate(tokens_a).view(np.uint64))[::-1].view(np.int64)  # the global order, common ones first
    up = every[::-1].view(np.uint64)

    def places(t: np.ndarray) -> np.ndarray:
        """Places in the order; shingles that no item of a has can add nothing."""
        at = np.minimum(np.searchsorted(up, t.view(np.uint64)), len(up) - 1)
        return np.sort(len(up) - 1 - at[up[at] == t.view(np.uint64)])

    tree = Tree.build([places(t) for t in tokens_a], sizes_a, known_a)
    out = []
    width = max(1, 30_000_000 // max(1, len(every)))
    for begin in range(0, len(tokens_b), width):
        own = np.arange(begin, min(begin + width, len(tokens_b)))
        has = np.zeros((len(every), len(own)), np.uint8)
        for j, i in enumerate(own.tolist()):
            has[places(tokens_b[i]), j] = 1
        sizes, known = sizes_b[own], known_b[own]
        stack = [(tree, np.arange(len(own)), np.zeros(len(own), np.int64))]
        while stack:
            node, who, overlap = stack.pop()
            fits = (sizes[who] * DEN >= node.low * NUM) & (sizes[who] * NUM <= node.high * DEN)
            if node.known is not None:
                fits &= known[who] != node.known
            who, overlap = who[fits], overlap[fits]
            if not len(who):
                continue
            for c in range(0, len(node.edge), 4096):
                overlap = overlap + has[node.edge[c : c + 4096]][:, who].sum(axis=0, dtype=np.int64)
            for i in node.items:
                hit = (overlap >= need(sizes_a[i], sizes[who])) & (known[who] != known_a[i])
                if hit.any():
                    out.append((i, own[who[hit]]))
            if node.children:
                alive = overlap + node.left >= need(np.maximum(node.low, -(-NUM * sizes[who] // DEN)), sizes[who])
                who, overlap = who[alive], overlap[alive]
                if len(who):
                    stack += [(c, who, overlap) for c in node.children]
    return out


def _forest(found: list[tuple[int, np.ndarray]], keys_a: np.ndarray, keys_b: np.ndarray) -> list[tuple[int, int]]:
    """The links' components as stars: (item, least item of its component)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, js in found:
        a = int(keys_a[i])
        for j in js.tolist():
            x, y = sorted((find(a), find(int(keys_b[j]))))
            parent[y] = x
    return [(x, find(x)) for x in parent if find(x) != x]


def _blocks() -> Column:
    """The number of blocks of a group's items."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(CELL))).cast("int")


def _blocked(groups: DataFrame, within: bool) -> DataFrame:
    """cell, side (0: stored in the tree, 1: goes down it, 2: both), and groups' columns. groups(group, node, size, known): each group
    is cut into blocks by size band and hash. within: blocks (by hash) meet themselves and the item that the group is named
    after; else all blocks that can link meet."""
    band: Column = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(DEN / NUM) + 1e-9).cast("int")
    whole = groups.groupBy("group").agg(_blocks().alias("blocks"))
    t = groups.withColumn("band", band).join(whole, "group")
    if within:
        own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")))
        cells = F.when(F.col("node") == F.col("group"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own)
        return t.withColumn("block", F.explode(cells)).select(F.xxhash64("group", "block").alias("cell"), F.lit(2).alias("side"), *groups.columns)
    small = t.where("blocks = 1").select(F.xxhash64("group").alias("cell"), F.lit(2).alias("side"), *groups.columns)
    large = t.where("blocks > 1").drop("blocks")
    counts = large.groupBy("group", "band").agg(_blocks().alias("n"))
    by_band = counts.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("bands"))  # some 50 bands at most
    large = large.join(by_band, "group")
    number = lambda at: F.coalesce(F.try_element_at("bands", at), F.lit(0))
    large = large.withColumn("own", F.struct("band", F.pmod(F.xxhash64("node"), number(F.col("band"))).cast("int").alias("j")))
    every = lambda at: F.when(number(at) > 0, F.transform(F.sequence(F.lit(0), F.greatest(number(at), F.lit(1)) - 1), lambda j: F.struct(at.alias("band"), j.alias("j")))).otherwise(F.array().cast("array<struct<band:int,j:int>>"))
    partners = F.concat(every(F.col("band") - 1), every(F.col("band")), every(F.col("band") + 1))
    large = large.withColumn("other", F.explode(partners)).select(
        F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), 2).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1)).alias("side"), *groups.columns,
    )
    return small.unionByName(large)


def _compare(items: DataFrame, placed: DataFrame) -> DataFrame:
    """a, b: edges between linked items of a cell that connect just what its links connect. placed(cell, side, group, node, size, known)."""

    def run(cell: pa.Table) -> pa.Table:
        edges: list[tuple[int, int]] = []
        groups = cell.column("group").to_numpy()
        for group in np.unique(groups).tolist():  # one, unless two cells share a hash
            t = cell.filter(pa.array(groups == group)).combine_chunks()
            side, keys, sizes, known = (t.column(c).to_numpy() for c in ("side", "node", "size", "known"))
            lists = t.column("tokens").combine_chunks()
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            tokens = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if len(a) and len(b) and len(set(known.tolist())) > 1:
                found = links([tokens[i] for i in a], sizes[a], [tokens[i] for i in b], sizes[b], known[a], known[b])
                edges += _forest(found, keys[a], keys[b])
        return pa.table([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], names=["a", "b"])

    full = placed.join(items.select("node", "tokens"), "node")
    return full.select("cell", "side", "group", "node", "size", "known", "tokens").groupBy("cell").applyInArrow(run, "a long, b long")


def link_components(items: DataFrame) -> DataFrame:
    """node, root: the components of the links, for items that have one."""
    prefix = common.materialise(items.where("prefix > 0").select("node", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token")), "jaccard-prefix")
    sizes = items.select("node", "size")
    # each item meets others at the least item with which it shares a prefix shingle
    star = common.materialise(prefix.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "hub"), "jaccard-star")
    met = prefix.join(star, "token").groupBy("node").agg(F.min("hub").alias("group"))
    met = common.materialise(met.unionByName(met.select(F.col("group").alias("node"), "group")).distinct().join(sizes, "node"), "jaccard-met")
    linked = graph.components(_compare(items, _blocked(met.withColumn("known", F.col("node")), within=True)))
    # the prefix shingles whose items are not all in one component so far
    known = prefix.join(star, "token", "left_semi").join(linked.withColumnRenamed("root", "known"), "node", "left")
    known = common.materialise(known.select("node", "token", F.coalesce("known", "node").alias("known")), "jaccard-known")
    sums = known.groupBy("token").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("signature"))
    left = known.join(sums.where("low < high").select("token", "low", "n", "signature"), "token")
    left = common.materialise(left, "jaccard-open")
    common.discard(prefix, star, met, known)
    if not left.isEmpty():
        more = _compare(items, _blocked(_exact(left).join(sizes, "node"), within=False))
        both = graph.components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        common.discard(linked)
        linked = both
    common.discard(left)
    return linked


def _exact(left: DataFrame) -> DataFrame:
    """Groups (group, node, known) that hold every pair of open items which share an open shingle. left(node, token, known, low, n,
    signature). A shingle's items are a group; shingles with the same items are one. Where that moves items often, families
    (components chained by open shingles) are groups instead if that moves fewer rows."""
    by_token = left.groupBy("n", "signature").agg(F.min("token").alias("token"), F.min("low").alias("low"))
    apart = left.join(by_token.select("token"), "token", "left_semi").select("token", "node", "known", "low", "n")
    moves = F.col("n") * F.ceil(F.col("n") / BLOCK)
    often, nodes = by_token.agg(F.sum(moves)).first()[0], left.agg(F.count_distinct("node")).first()[0]
    if often <= OFTEN * nodes:
        return apart.select(F.xxhash64("token").alias("group"), "node", "known")
    families = graph.components(left.select(F.col("known").alias("a"), F.col("low").alias("b")))
    of = lambda t, c: t.join(families.select(F.col("node").alias(c), F.col("root").alias("family")), c)
    own = of(left.select("node", "known").distinct(), "known")
    size = own.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    cost = of(by_token, "low").groupBy("family").agg(F.sum(moves).alias("apart")).join(size, "family")
    choice = common.materialise(cost.select("family", (F.col("apart") < F.col("m") * F.ceil(F.col("m") / BLOCK)).alias("by_token")), "jaccard-choice")
    one = of(apart, "low").join(choice.where("by_token"), "family").select(F.xxhash64("token").alias("group"), "node", "known")
    return one.unionByName(own.join(choice.where("not by_token"), "family").select(F.xxhash64("family").alias("group"), "node", "known"))


def near_components(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id, k1, k2 (the set's key); one row for each row of df."""
    spark = df.sparkSession
    common.small_batches(spark)
    both = common.materialise(_members(df, text, id), "jaccard-members")
    members = both.where("token is null").drop("token", "n")
    # a range of shingles is sorted in memory, so the number of ranges follows the number of shingles
    total, documents = members.agg(F.sum("n_shingles"), F.count(F.lit(1))).first()
    parts = max(common.partitions(spark), -(-(total or 0) // PART))
    often = both.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") * 4 * SHARE >= documents)
    frequent = [r.token for r in often.orderBy(F.col("n").desc(), "token").limit(HOTTEST).collect()]
    hot = spark.sparkContext.broadcast(np.sort(np.array(frequent, np.int64).view(np.uint64)))
    items = common.materialise(_items(_shared(_dealt(df, text, parts, hot), parts), parts), "jaccard-items")
    linked = link_components(items)
    # the least id of each set, then of each component
    own = members.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("id").alias("own"))
    sets = linked.join(items.select("node", "k1", "k2"), "node").join(own, ["k1", "k2"]).select("k1", "k2", "root", "own")
    sets = common.materialise(sets, "jaccard-sets")
    roots = sets.groupBy("root").agg(F.min("own").alias("component_id"))
    target = sets.join(roots, "root").select("k1", "k2", F.col("component_id").alias("joined"))
    target = common.materialise(own.join(target, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("joined", "own").alias("component_id")), "jaccard-target")
    common.discard(items, linked, sets)
    full = members.where("n_shingles > 0").join(target, ["k1", "k2"]).select("id", "n_shingles", "component_id", "k1", "k2")
    nothing = F.lit(None).cast("long")
    return full.unionByName(members.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), nothing.alias("k1"), nothing.alias("k2")))


def one_of_each(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """df's rows and columns, of each component only the rows with the least id. Documents without words all stay."""
    out = near_components(df, text, id)
    gone = out.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(id)).distinct()
    return df.join(common.materialise(gone, "jaccard-gone"), id, "left_anti").select(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(common.documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")

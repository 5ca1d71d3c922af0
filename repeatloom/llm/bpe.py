"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern is merged separately. Merging keeps a segment tree over byte positions: a leaf holds
the rank of the pair that begins at that live position, inner nodes (of fan-out 16) the leftmost minimum; a merge takes
the root, joins two live neighbours and updates at most three leaves, each in logarithmic time, so a token of n bytes
takes n log n steps however long it is. Distinct tokens of a block are merged once and remembered (Memo, bounded).

Null text counts as empty (no ids). Empty text has no ids. Columns of the input other than the two named ones are not
touched, whatever their names. Rows are independent: ties, repeats and empty tables need no special case.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from repeatloom.llm import common, vectext

_FAR, _FAN = 1 << 62, 16


def merge_ends(piece, ranks: dict) -> list[int]:
    """Merges piece (bytes or str) by rank, lowest first and leftmost of equals; the end of the symbol that begins at each
    live position. A segment tree of fan-out _FAN: a token of up to _FAN units has one inner node."""
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # of the live symbol that begins here
    before = list(range(-1, n))  # the live symbol before
    leaves = [_FAR] * (-(-n // _FAN) * _FAN)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            leaves[i] = r << 32 | i  # the position breaks ties, so the minimum is the leftmost
    levels = [leaves]
    while len(levels[-1]) > _FAN:
        low = levels[-1]
        high = [min(low[k : k + _FAN]) for k in range(0, len(low), _FAN)]
        high += [_FAR] * (-len(high) % _FAN)
        levels.append(high)
    above, top = levels[1:], levels[-1]
    while True:
        best = min(top)
        if best == _FAR:
            break
        i = best & 0xFFFFFFFF
        j = end[i]
        k = end[i] = end[j]
        leaves[j] = leaves[i] = _FAR
        if k < n:
            before[k] = i
            r = get(piece[i : end[k]])
            if r is not None:
                leaves[i] = r << 32 | i
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            leaves[h] = _FAR if r is None else r << 32 | h
        if above:
            for at in (max(h, 0), i, j):
                low = leaves
                for high in above:
                    at //= _FAN
                    high[at] = min(low[at * _FAN : at * _FAN + _FAN])
                    low = high
    return end


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one token's bytes."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, end = len(piece), merge_ends(piece, ranks)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encodes blocks of texts and decodes ids, with one vocabulary."""

    def __init__(self, path: str, capacity: int = 700_000):
        self.ranks = load_ranks(path)
        top = max(self.ranks.values()) + 1
        tokens = [b""] * top
        for t, r in self.ranks.items():
            tokens[r] = t
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.memo = vectext.Memo(self._merged, np.uint32, capacity)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [merge(w.encode("utf-8", "surrogatepass"), self.ranks) for w in words]
        return np.array([x for one in ids for x in one], np.uint32), np.array([len(one) for one in ids], np.int32)

    def encode(self, block: vectext.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and each document's bounds in them."""
        starts, ends = vectext.split_gpt2(block)
        ids, lens = self.memo.expand(self.memo.of_tokens(block, starts, ends))
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
        return ids, upto[block.offsets(starts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, ranks: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, ids (array of int): each whole text's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for block in vectext.blocks(vectext.texts(b.column(1))):
                ids, bounds = codec(ranks).encode(block)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(block)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], names=["id", "ids"])
                at += len(block)

    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[text]).mapInArrow(common.tidy(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def decode(df: DataFrame, ranks: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """id, bytes (binary): what each row's ids stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codec(ranks)
            rows = [c.decode(np.asarray(x, np.int64)) if x is not None else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["id", "bytes"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[ids]).mapInArrow(common.tidy(run), f"id {kind}, bytes binary").withColumnRenamed("id", id)


def round_trip_digests(df: DataFrame, ranks: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the decoded bytes), without moving ids between processes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for b in batches:
            at = 0
            for block in vectext.blocks(vectext.texts(b.column(1))):
                ids, bounds = c.encode(block)
                data, upto = c.decode(ids), np.concatenate([np.zeros(1, np.int64), np.cumsum(c.sizes[ids])])[bounds]
                text_ids, marks = _joined(ids)
                marks = marks[bounds]
                rows = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), upto[:-1].tolist(), upto[1:].tolist(), marks[:-1].tolist(), marks[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(block)),
                        pa.array([y - x for x, y, *_ in rows], pa.int64()),
                        pa.array([hashlib.sha256(text_ids[p : max(p, q - 1)]).hexdigest() for *_, p, q in rows]),
                        pa.array([hashlib.sha256(data[x:y]).hexdigest() for _, _, x, y, *_ in rows]),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(block)

    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[text]).mapInArrow(common.tidy(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)


def _joined(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each id in decimal with a comma after it, end to end, and where each begins (and the end)."""
    digits = np.ones(len(ids), np.int64)
    for ten in (10, 100, 1000, 10_000, 100_000, 1_000_000):
        digits += ids >= ten
    marks = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(digits + 1, out=marks[1:])
    out = np.full(int(marks[-1]), 44, np.uint8)
    rest, more = ids.astype(np.int64), np.ones(len(ids), bool)
    at = marks[1:] - 2
    for _ in range(7):
        out[at[more]] = 48 + rest[more] % 10
        rest, at = rest // 10, at - 1
        more = rest > 0
        if not more.any():
            break
    return out.tobytes(), marks


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

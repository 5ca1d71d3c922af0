"""Token counts of a public piece vocabulary with the whole-token shortcut.

The library writes each space as U+2581, puts one before the text and merges the best-scored neighbouring pieces. No
piece has that mark after another character (asserted on loading), so merges never leave a pre-token: a run of marks and
what follows up to the next mark. Before any text is read, the driver merges each vocabulary string of that form once; those
that end as one token are proven whole, and their set is broadcast (at most the vocabulary). Pre-tokens among them count 1
without merging; only the others are merged (once for each distinct one of a block, and remembered).

Null and empty texts have no tokens. Rows are independent, so ties, repeats and empty tables need no special case; other
columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from repeatloom.llm import common, vectext
from repeatloom.llm.bpe import merge_ends

LIMIT = 4096
MARK = "▁"


class Counter:
    def __init__(self, path: str, whole: frozenset[str] | None = None, capacity: int = 700_000):
        """whole: the strings proven to be one token; without it they are proven here."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        assert not any(sp.is_unused(i) for i in ids)
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        assert not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces), "a piece spans pre-tokens"
        order = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in pieces.items()}
        self.whole = frozenset(p for p in pieces if p[0] == MARK and self.merged(p) == 1) if whole is None else whole
        self.memo = vectext.Memo(self._count, np.int32, capacity)

    def merged(self, word: str) -> int:
        """The number of tokens after all merges; a character that is no piece counts a token for each of its bytes."""
        n = i = 0
        ends = merge_ends(word, self.ranks)
        while i < len(word):
            one = word[i : ends[i]]
            n += 1 if one in self.ranks else len(one.encode("utf-8", "surrogatepass"))
            i = ends[i]
        return n

    def _count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [w.replace(" ", MARK) for w in words]
        return np.array([1 if w in self.whole else self.merged(w) for w in words], np.int32), np.ones(len(words), np.int32)

    def count(self, block: vectext.Block) -> tuple[np.ndarray, np.ndarray]:
        """For a block whose texts have a space put before them: tokens and UTF-8 bytes of each document."""
        cps = block.cps
        space = (cps == 32) | (cps == ord(MARK))
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[block.bounds[:-1]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(cps))
        index = self.memo.of_tokens(block, starts, ends)
        tokens = vectext.doc_sums(self.memo.flat[self.memo.starts[index]].astype(np.int64), block.offsets(starts))
        width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
        size = vectext.doc_sums(width, block.bounds) - 1
        tokens[size == 0] = 0
        return size, tokens


_counters: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    """One for each vocabulary and process."""
    if path not in _counters:
        _counters[path] = Counter(path, whole)
    return _counters[path]


def count(df: DataFrame, model: str, limit: int = LIMIT, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than limit tokens)."""

    proof = df.sparkSession.sparkContext.broadcast(counter(model).whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model, proof.value)
        for b in batches:
            at = 0
            for block in vectext.blocks(vectext.texts(b.column(1)), prefix=" "):
                size, tokens = c.count(block)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(block)), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])
                at += len(block)

    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[text]).mapInArrow(common.tidy(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))

"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces (all its alphabetic strings, lower-cased). Each language has a
probability for each piece, learned by expectation maximisation over all segmentations of the training words. A word's
likelihood is the sum over all its segmentations (forward algorithm), a text's that of its words, and the score is the
posterior of the best language under equal priors. Words are whole runs of letters, however long (the forward sums are
rescaled on the way, and long runs are read in chunks); a letter that is no piece has a small fixed probability. Words are
scored once for each distinct one of a block, and those of up to REMEMBERED letters are remembered.

Training reads text and language only, from at most PER_LANGUAGE documents of each language (those of least id hash; of
each the whole words within its first LONGEST_TEXT characters): this bound is fixed, so training costs the same at any size;
there is no bound on the number of languages. Prediction reads every whole text.

Null text, and text without a letter: language `und`, score 0. Rows are independent; ties of languages go to the first
in alphabetical order. Without a training row every prediction is `und`. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.llm import common, vectext

REMEMBERED, CHUNK = 256, 16_384
PER_LANGUAGE, LONGEST_TEXT = 400, 20_000
ROUNDS, UNKNOWN, SMOOTH = 3, 1e-7, 0.05


def vocabulary(model: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    found = {sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    return sorted(p for p in found if p.isalpha())


class Pieces:
    """The vocabulary as a letter trie: transitions are exact, by (node, letter)."""

    def __init__(self, pieces: list[str]):
        nodes: dict[tuple[int, int], int] = {}
        piece = [len(pieces)]  # of each node: its piece, or none
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                key = at, ord(c)
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(len(pieces))
                at = nodes[key]
            piece[at] = i
        keys = np.array([a << 21 | c for a, c in nodes], np.int64).reshape(-1)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece, self.n, self.longest = np.array(piece, np.int32), len(pieces), max([1, *map(len, pieces)])

    def starts(self, cps: np.ndarray, room: np.ndarray) -> np.ndarray:
        """For each place of a run of letters with so much room to its end: the pieces of 1, 2, ... letters that begin there (n: none, n + 1: unknown letter)."""
        out = np.full((len(cps), self.longest), self.n, np.int32)
        at, node = np.arange(len(cps)), np.zeros(len(cps), np.int64)
        for k in range(self.longest):
            ok = room[at] > k
            at, node = at[ok], node[ok]
            if not len(at) or not len(self.keys):
                break
            key = node << 21 | cps[at + k].astype(np.int64)
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[j] == key
            at, node = at[ok], self.to[j[ok]]
            out[at, k] = self.piece[node]
        out[:, 0] = np.where(out[:, 0] == self.n, self.n + 1, out[:, 0])
        return out

    def batches(self, words: list[str], groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of like length: positions in words, lengths, and pieces by (word, place, letters); past a word's end there is none.
        A batch is small enough for arrays over its places and that many groups."""
        most = 3_000_000 // max(self.longest, 4 * groups)
        lens = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lens, kind="stable")
        a = 0
        while a < len(order):
            least, b = lens[order[a]], a
            while b < len(order) and lens[order[b]] <= least + least // 16 and (b - a + 1) * lens[order[b]] <= most:
                b += 1
            own = order[a : max(b, a + 1)]
            n = int(lens[own].max())
            block = vectext.Block([words[i] for i in own])
            size = lens[own]
            place, _, _ = vectext.spread(block.bounds[:-1], size)
            flat = self.starts(block.cps, np.repeat(size, size) - place)
            ids = np.full((len(own), n, self.longest), self.n, np.int32)
            ids[np.repeat(np.arange(len(own)), size), place] = flat
            some = np.flatnonzero((ids[:, :, 1:] != self.n).any(axis=(0, 1)))
            yield own, size, ids[:, :, : (int(some[-1]) + 2 if len(some) else 1)]
            a = max(b, a + 1)


def _scaled(window: np.ndarray, log: np.ndarray) -> None:
    """Divides what later places read by its greatest value, which goes into log."""
    top = window.max(axis=1)
    top[top == 0] = 1.0
    window /= top[:, None]
    log += np.log(top)


def forward(ids: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """(word, place, language): the logarithm of the summed probability of all segmentations of the letters before the place."""
    count, n, longest = ids.shape
    a = np.zeros((count, n + 1, probs.shape[1]))
    a[:, 0] = 1
    out, log = np.full_like(a, -np.inf), np.zeros((count, probs.shape[1]))
    out[:, 0] = 0
    with np.errstate(divide="ignore"):
        for j in range(1, n + 1):
            k = np.arange(1, min(longest, j) + 1)
            a[:, j] = (a[:, j - k] * probs[ids[:, j - k, k - 1]]).sum(axis=1)
            out[:, j] = np.log(a[:, j]) + log
            if j % 8 == 0:
                _scaled(a[:, max(0, j - longest + 1) : j + 1], log)
    return out


def backward(ids: np.ndarray, lens: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """(word, place, language): likewise of the letters from the place on."""
    count, n, longest = ids.shape
    b = np.zeros((count, n + longest + 1, probs.shape[1]))
    out, log = np.full((count, n + 1, probs.shape[1]), -np.inf), np.zeros((count, probs.shape[1]))
    k = np.arange(longest)
    with np.errstate(divide="ignore"):
        for i in range(n, -1, -1):
            if i < n:
                b[:, i] = (b[:, i + 1 + k] * probs[ids[:, i, k]]).sum(axis=1)
            b[lens == i, i] = 1
            out[:, i] = np.log(b[:, i]) + log
            if i % 8 == 0:
                _scaled(b[:, i : i + longest], log)
    return out


def long_word(cps: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """The log likelihood of one run of letters of any length, for each language; CHUNK places at a time."""
    reach = pieces.longest
    k = np.arange(1, reach + 1)
    a, log = np.zeros((reach + CHUNK, probs.shape[1])), np.zeros((1, probs.shape[1]))
    a[reach - 1] = 1
    before = np.full((reach, reach), pieces.n, np.int32)  # the pieces of the places before the chunk
    for c in range(0, len(cps), CHUNK):
        part = cps[c : c + CHUNK + reach]
        here = min(CHUNK, len(cps) - c)
        ids = np.concatenate([before, pieces.starts(part, np.arange(len(part), 0, -1))[:here]])
        for j in range(reach + 1, reach + here + 1):  # the place after letter j - 1 of ids is row j - 1 of a
            a[j - 1] = (a[j - 1 - k] * probs[ids[j - k, k - 1]]).sum(axis=0)
            if j % 8 == 0:
                _scaled(a[None, j - reach : j], log)
        before = ids[here : here + reach]
        a[:reach] = a[here : here + reach]
    return (np.log(a[reach - 1]) + log[0]) if len(cps) else np.zeros(probs.shape[1])


def train(words: list[str], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Probabilities (pieces and two more rows: none, unknown) x languages, from distinct words and their counts in each language."""
    groups = counts.shape[1]

    def settled(expected: np.ndarray) -> np.ndarray:
        p = expected[: pieces.n] + SMOOTH
        p = p / p.sum(axis=0)
        return np.vstack([p, np.zeros((1, groups)), np.full((1, groups), UNKNOWN)])

    def add(expected: np.ndarray, ids: np.ndarray, flow: np.ndarray) -> None:
        for g in range(groups):
            expected[:, g] += np.bincount(ids.ravel(), flow[..., g].ravel(), pieces.n + 2)

    expected = np.zeros((pieces.n + 2, groups))
    for at, _, ids in pieces.batches(words, groups):  # to begin with: how often each piece occurs at all
        for k in range(ids.shape[2]):
            add(expected, ids[:, :, k], np.broadcast_to(counts[at][:, None], (*ids.shape[:2], groups)))
    probs = settled(expected)
    for _ in range(ROUNDS):
        expected = np.zeros((pieces.n + 2, groups))
        for at, lens, ids in pieces.batches(words, groups):
            fw, bw = forward(ids, probs), backward(ids, lens, probs)
            total = fw[np.arange(len(at)), lens]
            n = ids.shape[1]
            for k in range(min(ids.shape[2], n)):
                from_, to = fw[:, : n - k], bw[:, k + 1 : n + 1]
                flow = np.exp(np.minimum(from_ + to - total[:, None], 700)) * probs[ids[:, : n - k, k]] * counts[at][:, None]
                add(expected, ids[:, : n - k, k], flow)
        probs = settled(expected)
    return probs


class Model:
    """Languages and piece probabilities; predicts blocks."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.strings, self.probs = languages, pieces, probs
        self.memo = None

    def __getstate__(self):
        return self.languages, self.strings, self.probs

    def __setstate__(self, state):
        self.__init__(*state)

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(words), len(self.languages)))
        for at, lens, ids in self.pieces.batches(words, len(self.languages)):
            out[at] = forward(ids, self.probs)[np.arange(len(at)), lens]
        return out.ravel(), np.full(len(words), len(self.languages), np.int32)

    def predict(self, block: vectext.Block) -> tuple[list[str], np.ndarray]:
        if self.memo is None and self.languages:
            self.pieces = Pieces(self.strings)
            self.memo = vectext.Memo(self._score, np.float64, max(1000, 1_200_000 // len(self.languages)))
        n, groups = len(block), len(self.languages)
        starts, ends, low = vectext.letter_words(block)
        offsets = block.offsets(starts)
        if not groups:
            return ["und"] * n, np.zeros(n)
        short = ends - starts <= REMEMBERED
        index = self.memo.of_tokens(block, starts[short], ends[short], low)
        total, value = np.empty((n, groups)), np.zeros(len(starts))
        for g in range(groups):
            value[short] = self.memo.flat[self.memo.starts[index] + g]
            total[:, g] = vectext.doc_sums(value, offsets)
        for i in np.flatnonzero(~short).tolist():
            total[np.searchsorted(block.bounds, starts[i], side="right") - 1] += long_word(low[starts[i] : ends[i]], self.pieces, self.probs)
        total -= total.max(axis=1, keepdims=True)
        post = np.exp(total)
        post /= post.sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        some = np.diff(offsets) > 0
        return [self.languages[g] if ok else "und" for g, ok in zip(best.tolist(), some.tolist())], np.where(some, post[np.arange(n), best], 0.0)


def fit(df: DataFrame, model: str, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Model:
    """Learns from df's rows with text and language; what reaches the driver is the bounded sample, drawn by the id's hash."""
    head = F.substring(df[text], 1, LONGEST_TEXT)
    words = F.regexp_replace(head, r"[^\p{L}][\p{L}]*+$", " ")  # without the word that the end may cut
    known = df.select(F.when(F.length(df[text]) > LONGEST_TEXT, words).otherwise(df[text]).alias("text"), df[lang].alias("lang"), F.xxhash64(df[id]).alias("rank")).where("text is not null and lang is not null")
    rows = common.draw(known, F.col("rank"), PER_LANGUAGE, "lang").select("lang", "text").collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    languages = sorted({r["lang"] for r in rows})
    where: dict[str, int] = {}
    entries: list[tuple[int, int]] = []
    for g, name in enumerate(languages):
        for block in vectext.blocks([r["text"] for r in rows if r["lang"] == name]):
            starts, ends, low = vectext.letter_words(block)
            low_text = low.tobytes().decode("utf-32-le", "surrogatepass")
            entries += [(where.setdefault(low_text[a:b], len(where)), g) for a, b in zip(starts.tolist(), ends.tolist())]
    counts = np.zeros((len(where), len(languages)))
    if entries:
        e = np.array(entries)
        np.add.at(counts, (e[:, 0], e[:, 1]), 1)
    strings = vocabulary(model)
    return Model(languages, strings, train(list(where), counts, Pieces(strings)))


def predict(df: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, lang_pred, score; one row for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x pieces: fixed by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for block in vectext.blocks(vectext.texts(b.column(1))):
                names, score = shared.value.predict(block)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(block)), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])
                at += len(block)

    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[text]).mapInArrow(common.tidy(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id)


def fold(id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(folds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")

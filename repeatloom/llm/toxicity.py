"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words' features (the word and its
first four and six letters, lower-cased); the document's is the noisy-or of its sentences, so one toxic sentence makes a
toxic document. In a document of more than MANY sentences each sentence's odds are divided by their number over MANY, in
training and in scoring: the more sentences there are, the more stands out by chance, and without this both the background
of clean sentences and the worst of them would grow with the length alone. Weights are learned from document labels alone, by gradient steps on the bag likelihood; afterwards
the sentence probabilities locate the offending sentences.

Training reads text and label from at most PER_LABEL documents of each label (least hash first), whole and of any length,
toxic and clean ones each as far as they fit into MOST_TEXT characters together (if none fits, the shortest alone), a fixed
bound; of their features the FEATURES ones that tell labels apart best (chi-square) get weights.
Scoring reads every whole text; the weights are a fixed-size broadcast.

Null and empty texts have no sentence: they get the background probability of a document without one, 0. Ids are not
read; rows that repeat a document are scored alike. A document with both labels trains as either. Without training rows of both
labels every score is 0. Other columns are not read. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.llm import common, vectext
from repeatloom.llm.language import fold

PER_LABEL, MOST_TEXT = 2000, 10_000_000
MANY = 100
FEATURES, LEAST_DOCS, STEPS, RATE, SHRINK, BASE = 30_000, 3, 150, 0.15, 2e-5, -5.0
LEAST_CHI, BUCKETS = 6.0, 1 << 22
_STOPS = [ord(c) for c in ".!?\n|"]


def sentences(block: vectext.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First and last character of each sentence that has a word, its document, the sentence of each word, and each word's features."""
    starts, ends, low = vectext.letter_words(block)
    stop = np.isin(block.cps, np.array(_STOPS, np.uint32))
    part = np.concatenate([np.zeros(1, np.int64), np.cumsum(stop)])[starts]
    doc = np.searchsorted(block.bounds, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    if len(starts):
        new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    tail = np.append(head[1:], len(starts)) - 1 if len(head) else head
    whole, *heads = block.hashes(starts, ends, low, heads=(4, 6))
    features = [whole] + [vectext.mix(h + np.uint64(n)) for h, n in zip(heads, (4, 6))]
    return starts[head], ends[tail] if len(head) else head, doc[head], sentence, features


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, base: float):
        self.keys, self.weights, self.base = keys, weights, base

    def score(self, block: vectext.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each document's probability, and that, start and end of its most toxic sentence (within the document; -1 without one)."""
        first, last, doc, sentence, features = sentences(block)
        n = len(block)
        z = np.full(len(first), self.base)
        if len(self.keys) and len(first):
            for h in features:
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                z += np.bincount(sentence, np.where(self.keys[at] == h, self.weights[at], 0.0), len(first))
        z -= _excess(doc, n)[doc]
        own = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        none = np.logaddexp(0, z)  # -log(1 - p)
        p = -np.expm1(-np.bincount(doc, none, n)) if len(first) and len(self.keys) else np.zeros(n)
        start, end = np.full(n, -1), np.full(n, -1)
        order = np.lexsort((-first, z))  # the greatest last; of equals the first
        start[doc[order]], end[doc[order]] = (first - block.bounds[doc])[order], (last - block.bounds[doc])[order]
        worst = np.zeros(n)
        worst[doc[order]] = own[order]
        return p, worst, start, end


def _excess(doc: np.ndarray, n: int) -> np.ndarray:
    """What is taken off the log odds of each document's sentences."""
    return np.log(np.maximum(1, np.bincount(doc, minlength=n) / MANY))


def _entries(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block and kind of feature: hashes, and the sentence and document of each, numbered through."""
    at = base = 0
    for block in vectext.blocks(texts):
        first, _, doc, sentence, features = sentences(block)
        for h in features:
            yield h, sentence + base, (doc + at)[sentence] if len(first) else sentence
        at, base = at + len(block), base + len(first)


def _chi(yes: np.ndarray, every: np.ndarray, share: float) -> np.ndarray:
    """How far a feature's documents depart from the share of positive ones; 0 for rare features."""
    chi = (yes - every * share) ** 2 / np.maximum(every * share * (1 - share), 1e-9)
    chi[every < LEAST_DOCS] = 0
    return chi


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Features are counted by hash bucket first, so memory is that of the buckets and of the features that stay."""
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), BASE)
    share = labels.mean()
    yes, every = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    count = 0
    for h, s, d in _entries(texts):
        seen = np.unique(((h % np.uint64(BUCKETS)).astype(np.int64) << 32) | d)  # a feature counts once a document
        np.add.at(every, seen >> 32, 1)
        np.add.at(yes, seen >> 32, labels[seen & 0xFFFFFFFF])
        count = max(count, int(s[-1]) + 1 if len(s) else 0)
    wanted = _chi(yes, every, share) > LEAST_CHI
    kept = [(h[m], s[m], d[m]) for h, s, d in _entries(texts) if (m := wanted[h % np.uint64(BUCKETS)]) is not None]
    kinds, words, docs = (np.concatenate(x) for x in zip(*kept))
    sentence_doc = np.zeros(count, np.int64)
    for _, s, d in _entries(texts):
        sentence_doc[s] = d
    keys, index = np.unique(kinds, return_inverse=True)
    seen = np.unique(index.astype(np.int64) << 32 | docs)
    chi = _chi(np.bincount(seen >> 32, labels[seen & 0xFFFFFFFF], len(keys)), np.bincount(seen >> 32, minlength=len(keys)), share)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
    chosen = chosen[chi[chosen] > LEAST_CHI]
    place = np.full(len(keys), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[index] >= 0
    row, col = words[use], place[index[use]]
    w, b = np.zeros(len(chosen)), BASE
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    y, less = labels.astype(float), _excess(sentence_doc, len(texts))[sentence_doc]
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, w[col], len(sentence_doc)) - less
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        total = np.maximum(np.bincount(sentence_doc, np.logaddexp(0, z), len(texts)), 1e-9)
        pull = np.where(y > 0, 1 / np.expm1(np.minimum(total, 500)), -1.0)  # (1 - P) / P, or -1
        g = p * pull[sentence_doc]
        gw = np.bincount(col, g[row], len(w)) / len(texts) - SHRINK * w
        gb = g.sum() / len(texts)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w = w + RATE * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b = min(b + RATE * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8), BASE)
    return Model(keys[chosen], w, b)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic") -> Model:
    """Learns from labels(id, label); the sample of labels is drawn first, so the join with documents is by a table of fixed size."""
    known = labels.select(labels[id].alias("id"), labels[label].alias("label")).where("id is not null and label is not null").distinct()
    drawn = common.draw(known, F.xxhash64("id"), PER_LABEL, "label").select("id", "label")
    texts = docs.select(docs[id].alias("id"), docs[text].alias("text")).where("text != ''")
    sizes = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.sum(F.length("text")).alias("n"), F.first(F.xxhash64("id")).alias("rank")).collect()
    chosen = []
    for kind in (True, False):
        mine, room = sorted((r for r in sizes if (r["label"] > 0) == kind), key=lambda r: (r["rank"], r["label"])), MOST_TEXT
        if mine and min(r["n"] for r in mine) > room:
            mine = [min(mine, key=lambda r: r["n"])]
            room = mine[0]["n"]
        for r in mine:
            if r["n"] <= room:
                chosen.append((r["id"], r["label"]))
                room -= r["n"]
    picked = docs.sparkSession.createDataFrame(chosen, drawn.schema)
    rows = texts.join(F.broadcast(picked), "id").select("id", "text", "label").collect()
    rows.sort(key=lambda r: (r["id"], r["label"], r["text"]))
    model = train([r["text"] for r in rows], np.array([int(r["label"] > 0) for r in rows]))
    del rows
    common.release()
    return model


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score, and worst_score, worst_start, worst_end of the most toxic sentence (code points; -1 without one)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    names = [*keep, "score", "worst_score", "worst_start", "worst_end"]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for block in vectext.blocks(vectext.texts(b.column(width))):
                out = shared.value.score(block)
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(at, len(block)) for i in range(width)], *[pa.array(x) for x in out]], names=names)
                at += len(block)

    given = df.select(*[df[c] for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", score double, worst_score double, worst_start long, worst_end long"
    return df.select(*[df[c] for c in keep], df[text].alias("_text")).mapInArrow(common.tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end")

"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The base kinds are fixed patterns (assign, access, hex), leftmost and non-overlapping for each kind. The method adds the
kind `markov`: runs of LEAST or more token characters, or what base spans leave of them, that look random as a whole or in
a stretch. Two first-order models
over character classes of 64 symbols are trained from labelled samples: random strings over the usual secret alphabets (hex,
base 32, base 62, base 64), and ordinary identifiers (the names of the Python standard library, joined words of a bounded
sample of documents, in snake, kebab, camel and plain case). A run is a secret if its log-likelihood ratio is at least
MARGIN nats, and PER_CHARACTER nats a character. Of a run that is none, each maximal scoring stretch (by the ratio less
PER_CHARACTER a character; Ruzzo and Tompa, linear in the run) is tested likewise, with the logarithm of the run's length
added to MARGIN for the choice of its place; a stretch reaches to the next separators where it passes so too.

Null and empty texts have no span. Offsets are code points, ends exclusive; the end of a base span is its match's.
Rows are independent, so ties and repeats need no special case. Other columns are kept by `redact`. Empty table: no rows.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import random
import re
import string
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.llm import common

LEAST, MARGIN, PER_CHARACTER = 20, 12.0, 0.5
SAMPLE_DOCS, SAMPLE_TEXT, SAMPLE_SEED = 400, 20_000, 20240101
KINDS = ("assign", "access", "hex", "markov")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run shorter than 20 fails as a whole, as does what is within it
HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")  # one of them is in every assign match
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)

_SYMBOLS = np.full(128, 63, np.uint8)
for _i, _c in enumerate(string.ascii_lowercase + string.digits + string.ascii_uppercase):
    _SYMBOLS[ord(_c)] = _i
_START = 64


_SEPARATORS = "/_=-"


def stretches(gain: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring stretches of a list of scores, first and end, from left to right."""
    first, end, low, high, link = [], [], [], [], []  # low, high: the sums before and after; link: the nearest earlier one of less low
    total = 0.0
    for i, g in enumerate(gain):
        before, total = total, total + g
        if g <= 0:
            continue
        a, lo, hi = i, before, total
        while True:
            j = len(first) - 1
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            a, lo = first[j], low[j]
            for x in (first, end, low, high, link):
                del x[j:]
        for x, v in zip((first, end, low, high, link), (a, i + 1, lo, hi, j)):
            x.append(v)
    return list(zip(first, end))


def _codes(s: str) -> np.ndarray:
    return np.concatenate([[_START], _SYMBOLS[np.frombuffer(s.encode("ascii"), np.uint8)]]).astype(np.int64)


class Markov:
    """First-order transitions between symbols, with add-one-half smoothing."""

    def __init__(self, samples: list[str]):
        counts = np.full((65, 64), 0.5)
        for s in samples:
            c = _codes(s)
            np.add.at(counts, (c[:-1], c[1:]), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))


class Detector:
    def __init__(self, random_strings: list[str], identifiers: list[str]):
        self.ratio = Markov(random_strings).log - Markov(identifiers).log

    def score(self, s: str) -> float:
        """The log-likelihood ratio of a random string to an identifier."""
        c = _codes(s)
        return float(self.ratio[c[:-1], c[1:]].sum())

    def secret(self, s: str) -> bool:
        return (x := self.score(s)) >= MARGIN and x >= PER_CHARACTER * len(s)

    def found(self, s: str) -> list[tuple[int, int]]:
        """The secret parts of a run: all of it, or its stretches."""
        if len(s) < LEAST:
            return []
        if self.secret(s):
            return [(0, len(s))]
        c = _codes(s)
        gain = self.ratio[c[:-1], c[1:]] - PER_CHARACTER
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        if (sums - np.minimum.accumulate(sums)).max() <= 0:
            return []
        whole = np.concatenate([[0.0], np.cumsum(gain + PER_CHARACTER)])
        begin = self.ratio[_START, c[1:]]
        margin = MARGIN + np.log(len(s))
        cuts = np.flatnonzero(np.isin(np.frombuffer(s.encode("ascii"), np.uint8), [ord(x) for x in _SEPARATORS]))
        out: list[tuple[int, int]] = []
        for a, b in stretches(gain.tolist()):
            if out and b <= out[-1][1]:
                continue
            k, n = np.searchsorted(cuts, a), np.searchsorted(cuts, b)
            left, right = int(cuts[k - 1]) + 1 if k else 0, int(cuts[n]) if n < len(cuts) else len(s)
            for x, y in ((left, right), (left, b), (a, right), (a, b)):
                if y - x >= LEAST and begin[x] + whole[y] - whole[x + 1] >= max(margin, PER_CHARACTER * (y - x)):
                    if out and x < out[-1][1]:
                        x = out.pop()[0]
                    out.append((x, y))
                    break
        return out

    def _rest(self, text: str, a: int, b: int, after: bool, before: bool) -> list[tuple[str, int, int]]:
        while after and a < b and text[a] in _SEPARATORS:
            a += 1
        while before and a < b and text[b - 1] in _SEPARATORS:
            b -= 1
        return [("markov", a + x, a + y) for x, y in self.found(text[a:b])]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        out = []
        low = text.lower()
        if any(h in low for h in _HINTS):
            out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
        runs = [(m.start(), m.end()) for m in RUN.finditer(text)]
        for a, b in runs:  # the other base kinds lie within runs
            out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text, a, b)]
            out += [("hex", m.start(), m.end()) for m in HEX.finditer(text, a, b)]
        base = sorted((s, e) for _, s, e in out)
        at = 0
        for a, b in runs:
            while at < len(base) and base[at][1] <= a:
                at += 1
            left, k = a, at
            while k < len(base) and base[k][0] < b:  # what lies before each base span, without the separators beside it
                if left < base[k][0]:
                    out += self._rest(text, left, base[k][0], left > a, True)
                left, k = max(left, base[k][1]), k + 1
            if left < b:
                out += self._rest(text, left, b, left > a, False)
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def samples(words: list[str], seed: int = SAMPLE_SEED, n: int = 6000) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings, and identifiers made of the words and of the standard library's names."""
    rng = random.Random(seed)
    alphabets = [string.digits + "abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.digits + "ABCDEF"]
    noise = ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(20, 64))) for k in range(n)]
    names = sorted({*dir(builtins), *keyword.kwlist, *sys.stdlib_module_names, *dir(str), *dir(re), *dir(random), *dir(hashlib)})
    plain = sorted({w for w in [*words, *(p for x in names for p in x.split("_"))] if len(w) > 1 and w.isascii() and w.isalpha()})
    out = list(names)
    for _ in range(n):
        some = rng.choices(plain, k=rng.randint(1, 4))
        out += ["_".join(some), "-".join(some), "".join(w.title() for w in some), "".join(some), "/".join(some), "_".join(some).upper()]
        if rng.random() < 0.2:
            out.append(f"{'_'.join(some)}{rng.randint(0, 2030)}")
    return noise, out


def fit(df: DataFrame, text: str = "text", id: str = "doc_id") -> Detector:
    """Words for identifiers come from SAMPLE_DOCS documents at most (least id hash, of at most SAMPLE_TEXT characters)."""
    some = df.select(df[text].alias("text"), F.xxhash64(df[id]).alias("rank")).where("text is not null").where(F.length("text") <= SAMPLE_TEXT)
    rows = sorted(r["text"] for r in common.draw(some, F.col("rank"), SAMPLE_DOCS).select("text").collect())
    return Detector(*samples([w for t in rows for w in re.findall(r"[^\W\d_]+", t)]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, detector: Detector, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_markov, base_sha256, spans; one row for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(detector)  # a table of 65 x 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item in b.column(1):
                found = shared.value.spans(item.as_py() or "")
                base = joined([x for x in found if x[0] != "markov"])
                rows.append((*(sum(x[0] == k for x in found) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(found)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[text]).mapInArrow(common.tidy(run), f"id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string").withColumnRenamed("id", id)


def redact(df: DataFrame, detector: Detector, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each span (overlapping ones as one) of the text replaced by mark; nulls stay null."""
    shared = df.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("string")
    def clean(column):
        import pandas as pd

        def one(t):
            if not t:
                return t
            out, at = [], 0
            for _, a, b in shared.value.spans(t):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join([*out, t[at:]]) if out else t

        return pd.Series([one(t) for t in column], dtype=object)

    return df.withColumn(text, clean(df[text]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return scan(docs, fit(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")

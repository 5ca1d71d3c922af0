"""BPE, token counts and packing against the libraries."""

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repeatloom.llm import bpe, packing, tokencount, vectext

MULTI, BYTE, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
CODEC = bpe.codec(MULTI)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = "ab the s t're'll ve 'd'm <s></s><|endoftext|> \n\t\r\x0b\x1c\x85 　 1٣²Ⅷ½éñçß日本語🙂_-.,!?'\"́​▁\x00ﬁ"


def sample():
    rng = random.Random(1)
    out = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(3000)]
    out += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(300)]
    out += ["", " ", "''s", "a 's", "\n's", "x" * 4000, "ab" * 3000, " " * 500, "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<s>"]
    out += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    return out


def encoded(texts):
    for block in vectext.blocks(texts):
        ids, bounds = CODEC.encode(block)
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b]


def test_encoding_equals_the_library():
    texts = sample()
    for t, ids in zip(texts, encoded(texts), strict=True):
        assert ids.tolist() == TIK.encode_ordinary(t), t
        assert CODEC.decode(ids) == t.encode()


def thue(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """Complements of Thue-Morse words, which polynomial hashes modulo 2^64 confuse in any base, and hashes made to collide."""
    texts = [thue(n, *pair) for n in (1024, 2048, 4096) for pair in ("ab", "ba", "tQ", "Qt")] + ["one  two", "abc abd xyz", "don't " * 50]

    def check():
        codec, counter, own = bpe.Codec(MULTI), tokencount.Counter(MODEL), bpe.Codec(BYTE)
        for _ in range(2):  # from the memo too
            (block,) = vectext.blocks(texts)
            ids, bounds = codec.encode(block)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [TIK.encode_ordinary(t) for t in texts]
            (block,) = vectext.blocks(texts, prefix=" ")
            assert counter.count(block)[1].tolist() == [len(SP.encode(t)) for t in texts]
            assert [x[:-1].tolist() for x in packing.document_ids(texts, own)] == [HF.encode(t, add_special_tokens=False).ids for t in texts]

    check()
    monkeypatch.setattr(vectext.Block, "hashes", lambda self, starts, ends, cps=None, heads=(), where=None: (ends - starts).astype(np.uint64) % np.uint64(3))
    check()


def test_very_long_texts():
    """A million characters, as one word and as many."""
    rng = random.Random(5)
    texts = ["ab" * 500_000, "".join(rng.choices("abcdefgh    \n.'", k=1_000_000)), " " * 1_000_000]
    for t, ids in zip(texts, encoded(texts), strict=True):
        assert CODEC.decode(ids) == t.encode()
        if t is texts[1]:  # the library gives up on the others
            assert ids.tolist() == TIK.encode_ordinary(t)
    counter = tokencount.Counter(MODEL)
    for t in texts[1:]:
        (block,) = vectext.blocks([t], prefix=" ")
        assert counter.count(block)[1].tolist() == [len(SP.encode(t))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_round_trip(t):
    (ids,) = encoded([t])
    assert CODEC.decode(ids).decode() == t


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=400).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_merge_takes_the_leftmost_least_pair(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(CODEC.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in CODEC.ranks]
        if not ranked:
            break
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    whole = CODEC.ranks.get(piece)
    assert bpe.merge(piece, CODEC.ranks) == ([whole] if whole is not None else [CODEC.ranks[p] for p in parts])


def test_digests(docs, none):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, MULTI).collect()))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = TIK.encode_ordinary(r.text or "")
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip_digests(none, MULTI).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), MULTI), MULTI).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((r.text or "").encode() for r in docs.select("text").collect())


def test_counts_equal_the_library(docs, none):
    c, texts = tokencount.counter(MODEL), sample()
    i = 0
    for block in vectext.blocks(texts, prefix=" "):
        size, tokens = c.count(block)
        for s, n in zip(size, tokens):
            assert (s, n) == (len(texts[i].encode()), len(SP.encode(texts[i]))), texts[i]
            i += 1
    assert all(len(SP.encode(w.replace("▁", " ")[1:])) == 1 for w in sorted(c.whole)[::50] if w.strip("▁"))
    rows = tokencount.count(docs, MODEL, limit=100).collect()
    assert len(rows) == docs.count() and all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert tokencount.count(none, MODEL).count() == 0


def test_ids_equal_the_library():
    texts = [*sample(), None]
    for t, ids in zip(texts, packing.document_ids(texts, packing._codec(BYTE)), strict=True):
        assert ids.tolist() == HF.encode(t or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 50, 2048])
    h = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
    rows, n = packing.plan(h, cap)
    ranks, used = {}, {}
    for length, rank, number, first, offset in rows:
        ranks.setdefault(length, []).extend(range(rank, rank + number))
        for q in range(first, first + number):
            used.setdefault(q, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in h.items()}
    for v in used.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= cap
    bins = []
    for length in sorted((k for k, c in h.items() for _ in range(c)), reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= length]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= length
        else:
            bins.append(cap - length)
    assert len(used) == n == len(bins)


def check_packing(docs, rows, cap):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by_seq.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= cap
    want = []
    for d in docs:
        ids = HF.encode(d.text or "", add_special_tokens=False).ids + [0]
        for piece, (s, n) in enumerate(packing.cut(len(ids), cap)):
            want.append((d.doc_id is None, d.doc_id or 0, piece, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_packing(docs, none):
    given_ = docs.select("doc_id", "text").collect()
    for cap in (16, 2048):
        check_packing(given_, packing.pack_documents(docs, BYTE, cap).collect(), cap)
    assert packing.pack_documents(none, BYTE).count() == 0
    with_ids = packing.tokenise(docs, BYTE, 16, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in with_ids)


def test_cut():
    assert packing.cut(5, 2048) == [(0, 5)] and packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]



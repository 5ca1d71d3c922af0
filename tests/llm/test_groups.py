"""Sharding, exact dedup and the n-gram join against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from repeatloom.llm import dedup, graph, jaccard, registry, sharding

SF = "/root/testdata/sf0.001"


def fewest(sizes, shards):
    """The least capacity with which a greedy fill of sizes needs no more shards."""
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def shards_of(docs):
    text = F.coalesce(docs["text"], F.lit(""))
    return sharding.shard(docs, F.octet_length(text) + 1, F.unhex(F.sha2(text, 256)), docs["doc_id"], 8, {"crc": F.crc32(text.cast("binary"))})


def check_shards(docs, out):
    given = docs.select("doc_id", "text").collect()
    rows = out.collect()
    assert sorted((r.id is None, r.id or 0, r.size, r.crc) for r in rows) == sorted((d.doc_id is None, d.doc_id or 0, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in given)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    sizes = {}
    for d in given:
        t = (d.text or "").encode()
        h = hashlib.sha256(t).digest()
        sizes[h] = sizes.get(h, 0) + len(t) + 1
    totals = {}
    for r in rows:
        totals[r["shard"]] = totals.get(r["shard"], 0) + r.size
    assert max(totals.values()) <= fewest([sizes[h] for h in sorted(sizes)], 8)
    where = {}
    for r in rows:
        assert where.setdefault((r.size, r.crc), r["shard"]) == r["shard"]


def test_shards(spark, docs, none):
    check_shards(docs, shards_of(docs))
    check_shards(spark.read.parquet(f"{SF}/documents.parquet"), shards_of(spark.read.parquet(f"{SF}/documents.parquet")))
    assert shards_of(none).count() == 0
    hot = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    check_shards(hot, shards_of(hot))


def test_shard_query(spark):
    rows = registry.QUERIES["op2_minimax_shards"](spark, SF).collect()
    given = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((k, len(t) + 1, zlib.crc32(t)) for k, t in given.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and {r["shard"] for r in rows} == set(range(8))


@pytest.mark.parametrize("seed", range(5))
def test_capacity(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 50, rng.randint(1, 400)]) for _ in range(rng.randint(1, 300))]
    ends = spark.createDataFrame([(int(x),) for x in np.cumsum(sizes)], "end long")
    got, cuts = sharding.smallest_capacity(ends, sum(sizes), max(sizes), 8)
    assert got == fewest(sizes, 8) and cuts[-1] == sum(sizes)


def test_misra_gries():
    rng = random.Random(0)
    keys = ["hot"] * 400 + [str(rng.randint(0, 900)) for _ in range(900)]
    rng.shuffle(keys)
    m = dedup.MisraGries(10)
    m.add(keys)
    assert len(m.counts) <= 10 and keys.count("hot") - len(keys) / 11 <= m.counts["hot"] <= keys.count("hot")


def normal(t):
    return re.sub("[ \t-\r]+", " ", t or "")


def check_dedup(docs):
    given = docs.select("doc_id", "text").collect()
    rows = dedup.decide(docs, dedup.normal_digest(docs["text"]), docs["doc_id"]).collect()
    groups = {}
    for d in given:
        groups.setdefault(hashlib.sha256(normal(d.text).encode()).hexdigest(), []).append(d.doc_id)
    assert len(rows) == len(given)
    for h, ids in groups.items():
        own = [r for r in rows if r.digest == h]
        keep = min([i for i in ids if i is not None], default=None)
        assert sorted(map(str, ids)) == sorted(str(r.id) for r in own)
        assert all(r.group_size == len(ids) and r.keep_id == keep for r in own)
        assert [r.id for r in own if r.kept] == [keep]
    left = dedup.unique(docs).select("doc_id", "text").collect()
    assert sorted(hashlib.sha256(normal(r.text).encode()).hexdigest() for r in left) == sorted(groups)


def test_dedup(spark, docs, none, monkeypatch):
    check_dedup(docs)
    monkeypatch.setattr(dedup, "COUNTERS", 4)
    hot = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("same\t"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")), F.lit("text"))).otherwise(F.col("id").cast("string")).alias("text"))
    check_dedup(hot.unionByName(hot.limit(3)))
    check_dedup(hot.limit(40).unionByName(spark.range(50).select(F.lit(0).cast("long").alias("doc_id"), F.lit("same text").alias("text"))))  # rows that repeat wholly
    assert dedup.decide(none, dedup.normal_digest(none["text"]), none["doc_id"]).count() == 0
    assert dedup.unique(docs).columns == docs.columns


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df, rel = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, (tuple(x[rel.columns.index(c)] for c in cols) for x in rel.fetchall())))


def words(t):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = words(t)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def slow_components(given):
    sets = [shingle_set(d.text) for d in given]
    parent = list(range(len(given)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(given):
        if d.doc_id is not None:
            least[find(i)] = min(least.get(find(i), d.doc_id), d.doc_id)
    return sorted((d.doc_id is None, d.doc_id or 0, len(s), str(least.get(find(i)))) for i, (d, s) in enumerate(zip(given, sets)))


def check_join(docs):
    got = jaccard.near_components(docs).collect()
    assert sorted((r.id is None, r.id or 0, r.n_shingles, str(r.component_id)) for r in got) == slow_components(docs.select("doc_id", "text").collect())


def near_copies(spark, n, seed, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    other = [f"v{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        if i % 4 == 0:  # a passage shared by texts that are not alike
            w = [f"u{rng.randint(0, 10**6)}" for _ in range(200)] + other
        if i % 7 == 0:
            w = w[rng.randint(0, 20) :]
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_join(spark, docs, none, monkeypatch):
    check_join(docs)
    assert jaccard.near_components(none).count() == 0
    check_join(near_copies(spark, 150, 1, 8))
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # families of many blocks
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    monkeypatch.setattr(jaccard, "OFTEN", 1)
    check_join(near_copies(spark, 150, 2, 6))
    kept = jaccard.one_of_each(near_copies(spark, 60, 3, 2)).collect()
    assert len(kept) == len({c for *_, c in slow_components(near_copies(spark, 60, 3, 2).collect())})


def test_join_of_words_that_differ_by_structure(spark):
    """Words whose polynomial hashes agree in any base, and texts of a hundred thousand words."""
    thue = ["".join("ab"[(bin(i).count("1") + side) & 1] for i in range(2048)) for side in (0, 1)]
    rng = random.Random(2)
    long = [f"w{rng.randint(0, 10**9)}" for _ in range(100_000)]
    other = list(long)
    for _ in range(2000):
        other[rng.randrange(len(other))] = "x"
    rows = [(i, " ".join(["one two three four", t, "five six seven"])) for i, t in enumerate(thue)]
    rows += [(10, " ".join(long)), (11, " ".join(other)), (12, " ".join(long[:60_000]))]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"))


def test_links_in_a_cell():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = rng.choice(200, 40, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(5, 40), replace=False), rng.integers(200, 260, rng.integers(0, 6))])) for _ in range(20)]
        sizes = np.array([len(s) + rng.integers(0, 3) for s in sets])
        a, b = list(range(12)), list(range(12, 20))
        got = {(i, 12 + j) for i, js in jaccard.links([sets[i] for i in a], sizes[a], [sets[i] for i in b], sizes[b]) for j in js.tolist()}
        want = {(i, j) for i in a for j in b if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (sizes[i] + sizes[j] - k)}
        assert got == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(300, 300 + i) for i in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_components_unsettled(spark):
    path = spark.createDataFrame([(i * 7919 % 501, (i + 1) * 7919 % 501) for i in range(500)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(path, rounds=1)
    assert {r.root for r in graph.components(path).collect()} == {0}

"""What grows with the input: tasks by rows, classes of copies and of arrays with the same bounds, edit distances by columns."""

import random

import numpy as np
from pyspark.sql import functions as F

from repeatloom.config import CLASS_ARRAYS, Config
from repeatloom.functions import kernels as K
from repeatloom.functions import scan
from repeatloom.operators import arrays, extract, intervals, period
from repeatloom.plans import annotate


def dna(rng, n, letters="acgt"):
    return "".join(rng.choices(letters, k=n))


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_arrays_of_one_scale_beside_another_scale_s(spark):
    """Two arrays with the same bounds and different periods are two arrays, each with the class of its own unit."""
    rng = random.Random(2)
    short, long = dna(rng, 40), dna(rng, 130)
    rows = [(1, 900, "x", 1, 50.0, 40, "", short, ""), (1, 900, "x", 1, 50.0, 130, "", long, ""), (5, 600, "y", 2, 50.0, 40, "", short, "")]
    got = arrays.classify(spark.createDataFrame(rows, CLASS_ARRAYS.removesuffix(", array_num_ID long")), Config(), annotate.saver(spark)).collect()
    assert sorted((r.seqID, r.top_N, len(r.representative), r.array_num_ID) for r in got) == [("x", 40, 40, 1), ("x", 130, 130, 2), ("y", 40, 40, 3)]
    assert len({r["class"] for r in got}) == 2 and len({r["class"] for r in got if r.top_N == 40}) == 1


def test_mapping_is_dealt_by_rows(spark):
    """full_pipeline and mapped_repeats: few short arrays are many tasks, since each takes long."""
    rng = random.Random(7)
    save = annotate.saver(spark)
    texts = [(str(i), i, unit * 20) for i in range(40) for unit in [dna(rng, 30)]]
    s = save(spark.createDataFrame(texts, "seq_id string, num_id long, seq string").withColumn("length", F.length("seq").cast("long")))
    classed = save(spark.createDataFrame([(1, 600, i, n, 50.0, 30, "", t[:30], f"30_{n}", n) for i, n, t in texts], CLASS_ARRAYS))
    found = arrays.map_arrays(classed, s, save(extract.pieces(s)), Config())
    assert tasks(found) >= 8
    assert {r.arrayID for r in found.where("width between 29 and 31").select("arrayID").distinct().collect()} == set(range(40))


def test_copies_of_units(spark):
    """Rows of one text join their first row as the definition says, on the minus strand if the text reads alike on both."""
    rng = random.Random(4)
    cfg = Config(class_k=4)
    half = dna(rng, 6)
    base = [dna(rng, rng.randint(3, 14), "acg") for _ in range(30)] + [half + K.reverse_complement(half), "acgtacgt"]
    given = [(i, rng.choice(base), float(rng.randint(1, 5))) for i in range(150)]
    got = {r.id: (r["class"], r.plus) for r in arrays.greedy_classes(spark.createDataFrame(given, "id long, seq string, importance double"), cfg, annotate.saver(spark)).collect()}
    ring = lambda s: [(s * (2 + 4 // len(s)))[i : i + 4] for i in range(len(s))]
    order = sorted(given, key=lambda r: (-r[2], r[0]))
    taken, seeds = {}, 0
    for i, (a, s, _) in enumerate(order):
        if a in taken:
            continue
        seeds += 1
        taken[a] = (f"{len(s)}_{seeds}", True)
        for b, t, _ in order[i + 1 :]:
            if b not in taken and np.floor(len(s) * (1 - cfg.class_gate)) <= len(t) <= np.ceil(len(s) * (1 + cfg.class_gate)):
                f, r = (sum(x in set(ring(u)) for x in ring(s)) for u in (t, K.reverse_complement(t)))
                if max(f, r) and 1 - max(f, r) / len(s) <= cfg.class_distance:
                    taken[b] = (f"{len(s)}_{seeds}", f > r)
    assert got == taken and {p for _, p in taken.values()} == {True, False}


def test_blocks_of_units_meet(spark):
    """Blocks of few units give the edges of one block; the pairs of blocks are rows, k-mers are not."""
    rng = random.Random(9)
    save = annotate.saver(spark)
    rows = save(spark.createDataFrame([(i, dna(rng, rng.randint(5, 40), "ac")) for i in range(60)], "rank long, seq string"))
    one, many = (sorted(map(tuple, arrays.class_edges(rows, Config(), save, block=n).collect())) for n in (1000, 7))
    assert one == many and len(one) > 60


def test_regions_are_dealt_by_rows(spark):
    """split_arrays: few short regions are many tasks, since each takes long."""
    rng = random.Random(6)
    save = annotate.saver(spark)
    s = save(spark.createDataFrame([(i, i, dna(rng, 40) * 12) for i in range(40)], "seq_id long, num_id long, seq string"))
    regions = save(s.select("seq_id", F.lit(1).alias("start"), F.length("seq").alias("end")))
    found = arrays.split_regions(regions, s, save(extract.pieces(s)), Config(max_repeat=100))
    assert tasks(found) >= 8
    assert found.where("top_N = 40").select("numID").distinct().count() == 40


def slow_row(a, b, free):
    row = [0 if free else j for j in range(len(b) + 1)]
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row


def test_edit_rows():
    rng = random.Random(8)
    for _ in range(300):
        a, b = dna(rng, rng.randint(0, 70), "acg"), dna(rng, rng.randint(0, 90), "acg")
        for free in (False, True):
            assert K.edit_row(K._codes(a), K._codes(b), free).tolist() == slow_row(a, b, free)
    assert K._columns(list(b"acgt" * 40), list(b"acgt" * 41))[0][-1] == 4


def test_neighbours_in_one_pass(spark, monkeypatch):
    """edge_flags, neighbour_relations and gap_fill_candidates: no shuffle and no sort, and what windows give for the same intervals."""
    rng = random.Random(12)
    texts = [(i, dna(rng, n, letters)) for i, (n, letters) in enumerate([(0, "a"), (11, "a"), (700, "acgtn"), (900, "at"), (30, "gc"), (2500, "acgt"), (5, "a")])]
    s = spark.createDataFrame([*texts, (99, "a" * 9 + "t" + "g" * 40 + "c" * 700 + "a" * 9 + "tg")], "seq_id long, seq string")
    for places in (scan.kmer_places, in_small_pieces):
        monkeypatch.setattr(scan, "kmer_places", places)
        known = period.kmer_intervals(s, 10, "a", "t")
        plain = known.select("seq_id", "start", "end")
        assert plain.count() > 100
        for of in (intervals.edge_flags, intervals.neighbours, intervals.gap_candidates):
            got, want = of(known), of(plain)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def in_small_pieces(text, k):
    for a, part in scan.pieces(text, 64, k):
        ids, clear = scan.kmer_ids(scan.codes(part), k)
        at = np.flatnonzero(clear)
        order = np.argsort(ids[at], kind="stable")
        yield a, at[order], ids[at][order], part


def test_kmer_ids_of_short_texts():
    rng = random.Random(3)
    for n in range(45):
        for k in (1, 2, 3, 4, 7, 10, 12):
            text = dna(rng, n, "acg")
            ids = scan.kmer_ids(scan.codes(text), k)[0].tolist()
            words = [text[i : i + k] for i in range(n - k)]
            assert len(ids) == len(words) and len(set(ids)) == len(set(words)) == len(set(zip(ids, words)))

"""Passes over long sequences against plain loops, their growth, and array queries against code without Spark."""

import csv
import glob
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from repeatloom.config import Config
from repeatloom.functions import kernels as K
from repeatloom.functions import scan
from repeatloom.operators import arrays, extract, period, units
from repeatloom.plans import annotate, catalogue, report

SF = "/root/testdata/sf0.001"


def dna(rng, n, letters="acgt"):
    return "".join(rng.choices(letters, k=n))


@pytest.fixture
def texts():
    rng = random.Random(5)
    unit = dna(rng, 37)
    return [dna(rng, 400, "acgtn"), unit * 12 + dna(rng, 50), "", "acgt", dna(rng, 90) * 4, "n" * 60, dna(rng, 33, "acgtryk")]


@pytest.fixture
def table(spark, texts):
    return spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "seq_id long, seq string, length long")


def places(t, k):
    return [(t[i : i + k], i + 1) for i in range(len(t) - k) if "n" not in t[i : i + k]]


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_scans(spark, table, texts, piece, monkeypatch):
    monkeypatch.setattr(scan, "PIECE", piece)
    k = 5
    for t in texts:
        total, single = scan.window_totals(t, 50, k)
        assert len(total) == (max(1, -(-(len(t) - 50) // 50)) if len(t) >= 50 else 0)
        for w in range(len(total)):
            c = Counter(x for x, _ in places(t[w * 50 : w * 50 + 50], k))
            assert (total[w], single[w]) == (sum(c.values()), sum(v == 1 for v in c.values()))
        got = [(part[j : j + k], int(a + j + 1), int(d)) for a, at, gap, part in scan.next_distances(t, k, 7, 60) for j, d in zip(at, gap)]
        seen, want = {}, []
        for x, p in reversed(places(t, k)):
            if x in seen and 7 <= seen[x] - p <= 60:
                want.append((x, p, seen[x] - p))
            seen[x] = p
        assert sorted(got) == sorted(want)
        hits = [(int(a), int(m)) for at, misses in scan.hamming_places(t, "acgta", 2) for a, m in zip(at, misses)]
        assert hits == [(i, m) for i in range(len(t) - 4) if (m := sum(x != y for x, y in zip(t[i : i + 5], "acgta"))) <= 2]
        every = [(part[j : j + k], int(a + j + 1)) for a, at, _, part in scan.kmer_places(t, k) for j in at]
        assert sorted(every) == sorted(places(t, k))


def test_scan_queries(table, texts):
    got = sorted(tuple(r) for r in period.kmer_positions(table, 5, begins="a", ends="t").collect())
    assert got == sorted((i, x, p) for i, t in enumerate(texts) for x, p in places(t, 5) if x[0] == "a" and x[-1] == "t")
    got = sorted(tuple(r) for r in period.kmer_counts(table, 5).collect())
    want = []
    for i, t in enumerate(texts):
        where = {}
        for x, p in places(t, 5):
            where.setdefault(x, []).append(p)
        want += [(i, x, len(p), p[0], p[-1]) for x, p in where.items() if len(p) > 1]
    assert got == sorted(want)


def test_adaptive_cut(spark):
    """The threshold follows the number of repeated k-mers, not the sequence's length."""
    few = [("a", f"k{i:05d}", 2 + i % 3) for i in range(1500)]  # threshold 2
    some = [("b", f"k{i:05d}", 2 + i % 3) for i in range(2500)]  # threshold 3
    none = [("c", f"k{i:05d}", 2) for i in range(2500)]  # nothing reaches 3: a tenth
    many = [("d", f"k{i:05d}", 9) for i in range(8500)]  # threshold 9: 5000 at most
    got = Counter(r.seq_id for r in period.frequent_kmers(spark.createDataFrame(few + some + none + many, "seq_id string, kmer string, n long")).collect())
    assert got == {"a": 1500, "b": sum(n >= 3 for _, _, n in some), "c": 250, "d": 5000}


def test_texts_of_intervals(spark, table, texts, monkeypatch):
    monkeypatch.setattr(extract, "PIECE", 16)
    rng = random.Random(1)
    rows = []
    for i, t in enumerate(texts):
        for _ in range(20 if len(t) > 4 else 0):
            a = rng.randint(1, len(t))
            rows.append((i, a, rng.randint(a, len(t))))
    rows = sorted(set(rows))
    t = spark.createDataFrame(rows, "seq_id long, a long, b long")
    got = sorted(tuple(r) for r in extract.texts(t, extract.pieces(table), "seq_id", F.col("a"), F.col("b"), "text").collect())
    assert got == [(i, a, b, texts[i][a - 1 : b]) for i, a, b in rows]


def test_time_goes_up_with_the_length():
    rng = np.random.default_rng(0)
    took = []
    for n in (2_000_000, 6_000_000):
        t = np.frombuffer(b"acgt", np.uint8)[rng.integers(0, 4, n)].tobytes().decode()
        began = time.process_time()
        scan.window_totals(t, 1111, 10)
        for _ in scan.next_distances(t, 10, 7, 1000):
            pass
        for _ in scan.hamming_places(t, "acgtacgatcga", 2):
            pass
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0]


def test_canonical_units(spark):
    rows = catalogue.canonical_units(spark, SF).select("start", "representative", "class").collect()
    given = {r.unit_id: r.seq for r in catalogue.unit_table(spark, SF).collect()}
    templates = sorted((r.name, r.seq) for r in catalogue.template_table(spark, SF).collect())
    assert len(rows) == len(given)
    for r in rows:
        s, best = given[r.start], (Config.template_score + 1e-9, "", K.canonical(given[r.start]))
        turns = [s[x:] + s[:x] for x in range(1, len(s) + 1)]
        for name, t in templates:
            if np.floor(len(t) * 0.85) <= len(s) <= np.ceil(len(t) * 1.15):
                for turn in [*turns, *map(K.reverse_complement, turns)]:
                    score = K.edit_distance(turn, t) / max(len(s), len(t))
                    if score < best[0]:
                        best = (score, name, turn)
        assert (r["class"], r.representative) == best[1:]


def test_greedy_classes(spark):
    cfg = Config(class_k=4)
    given = sorted(((len(r.seq), r.unit_id, r.seq) for r in catalogue.unit_table(spark, SF).collect()), key=lambda r: (-r[0], r[1]))
    ring = lambda s: [(s * (2 + 4 // len(s)))[i : i + 4] for i in range(len(s))]
    taken, seeds = {}, 0
    for i, (_, a, s) in enumerate(given):
        if a in taken:
            continue
        seeds += 1
        taken[a] = (f"{len(s)}_{seeds}", True)
        for _, b, t in given[i + 1 :]:
            if b not in taken and np.floor(len(s) * (1 - cfg.class_gate)) <= len(t) <= np.ceil(len(s) * (1 + cfg.class_gate)):
                f, r = (sum(x in set(ring(u)) for x in ring(s)) for u in (t, K.reverse_complement(t)))
                if max(f, r) and 1 - max(f, r) / len(s) <= cfg.class_distance:
                    taken[b] = (f"{len(s)}_{seeds}", f > r)
    assert {r.id: (r["class"], r.plus) for r in catalogue.greedy_classes(spark, SF).collect()} == taken


def test_arrays_and_repeats(spark):
    """split_arrays, full_pipeline and mapped_repeats: every region and array again by the kernels alone, on whole texts."""
    whole = {str(r.seq_id): r.seq for r in catalogue.sequences(spark, SF).collect()}
    out = catalogue._annotation(spark, SF)
    found, least = [], 0
    for cfg in catalogue.RANGES:
        s = catalogue.sequences(spark, SF)
        for r in catalogue.windows.regions(catalogue.windows.singleton_score(catalogue.windows.kmer_totals(s, cfg.window, cfg.k), cfg.k), cfg.window, cfg.low_score).collect():
            text = whole[str(r.seq_id)][r.start - 1 : r.end]
            for a, b in K.segment(text, cfg):
                score, top, names, unit = K.describe_array(text[a - 1 : b], cfg)
                if cfg is catalogue.RANGES[0] or top > least:
                    found.append((str(r.seq_id), r.start + a - 1, r.start + b - 1, top, names, unit))
        least = cfg.max_repeat
    assert sorted((r.seqID, r.start, r.end, r.top_N, r.top_5_N, r.representative) for r in catalogue.split_arrays(spark, SF).collect()) == sorted(found)
    cfg, want = catalogue.RANGES[-1], []
    known = out.arrays.collect()
    assert len(known) == len(found)
    for a in known:
        if a["class"] != "none_identified" and a.representative:
            t, left = whole[a.seqID], max(1, a.start - cfg.max_repeat)
            r, _ = K.annotate_array(a.representative, a.top_N, t[a.start - 1 : a.end], a.start, t[left - 1 : a.end + cfg.max_repeat], left - 1, cfg)
            want += [(a.array_num_ID, int(r.start[i]), int(r.end[i]), "+" if r.plus[i] else "-", t[int(r.start[i]) - 1 : int(r.end[i])]) for i in range(len(r))]
    want = [(n, s, e, d, x if d == "+" else K.reverse_complement(x)) for n, s, e, d, x in want]
    got = arrays.with_sequence(out.repeats, out.pieces).collect()
    assert sorted((r.arrayID, r.start, r.end, r.strand, r.sequence) for r in got) == sorted(want)
    sizes = Counter(n for n, *_ in want)
    assert {r.array_num_ID: r.repeats_number for r in out.summary.collect()} == dict(sizes)


def test_files_can_be_read_back(spark, tmp_path):
    rng = random.Random(3)
    unit = dna(rng, 60)
    path = tmp_path / "g.fa"
    path.write_text(f">one\n{dna(rng, 3000)}{unit * 40}{dna(rng, 3000)}\n")
    out = annotate.run(spark, str(path), str(tmp_path / "out"), Config(max_repeat=200))
    tables = {"regarrays": out.regions, "aregarrays": out.found, "classarrays": out.arrays, "no_repeats_arrays": None, "arrays": out.summary, "repeats": out.repeats, "repeats_with_seq": out.repeats}
    for name, table in tables.items():
        (part,) = glob.glob(f"{tmp_path}/out/g.fa_{name}.csv/part-*")
        with open(part) as f:
            first = f.readline()
            f.seek(0)
            rows = list(csv.DictReader(f))
        assert first.startswith('"') and len(rows) == (table.count() if table is not None else 0)
        if rows and "start" in rows[0] and "array_num_ID" in rows[0]:
            numbers = [int(r["array_num_ID"]) for r in rows]
            assert numbers == sorted(numbers) and all(int(r["start"]) < int(r["end"]) for r in rows)


def test_report():
    assert [report.elapsed(x) for x in (3.21, 75, 3725)] == ["3.2s", "1m15s", "1h02m"]
    assert [report.span(x) for x in (12, 1500, 2_500_000)] == ["12bp", "1.5kbp", "2.50Mbp"]
    assert report.percent(1, 8) == "12.5%" and report.percent(1, 0) == "0.0%"


def test_pattern_hits(table, texts):
    got = sorted(tuple(r) for r in units.pattern_hits(table, "acgta", 1).collect())
    assert got == sorted((i, p + 1, m) for i, t in enumerate(texts) for p in range(len(t) - 4) if (m := sum(x != y for x, y in zip(t[p : p + 5], "acgta"))) <= 1)

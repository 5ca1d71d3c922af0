"""Queries against DuckDB at sf0.001, FASTA reading, sinks, the whole pipeline on a made genome, streaming."""

import gzip
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from repeatloom.config import Config
from repeatloom.functions import kernels as K
from repeatloom.plans import annotate, catalogue
from repeatloom.sources import fasta, sinks
from repeatloom.streaming import regions as streaming

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    rnd = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(rnd(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(rnd(x[i]) for i in at) for x in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fasta(spark, tmp_path):
    text = "junk\n>a one\r\nACGT\r\nacNN\r\n>\nTT\n>a two\nGG-R\n>b\nC\n"
    (tmp_path / "x.fa").write_text(text)
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(text)
    want = [(1, "a1", "acgtacnn"), (2, "", "tt"), (3, "a2", "gg-r"), (4, "b", "c")]
    for name in ("x.fa", "x.fa.gz"):
        rows = fasta.sequences(spark, str(tmp_path / name)).orderBy("num_id").collect()
        assert [(r.num_id, r.seq_id, r.seq) for r in rows] == want
    (tmp_path / "none.fa").write_text("")
    assert fasta.sequences(spark, str(tmp_path / "none.fa")).isEmpty()
    with pytest.raises(ValueError):
        fasta.templates(spark, str(tmp_path / "none.fa"))


def test_search_hits(spark, tmp_path):
    row = "t - q - 1 9 20 11 {a} {b} 99 {s} 1e-5 42.5 0.1 -"
    (tmp_path / "t").write_text("# head\n" + row.format(a=11, b=20, s="+") + "\n" + row.format(a=40, b=31, s="-") + "\nshort line\n")
    got = [tuple(r) for r in fasta.search_hits(spark, str(tmp_path / "t"), "s", 3).orderBy("start").collect()]
    assert got == [("s", 3, 11, 20, "+", 42.5, 1e-5), ("s", 3, 31, 40, "-", 42.5, 1e-5)]


def test_csv_numbers(spark):
    df = spark.createDataFrame([("a", 1, 1.5, 2.0, True), ("b\"c", 2, 1 / 3, -1.0, False)], "s string, i long, x double, y double, b boolean")
    assert [r.line for r in sinks.csv(df).collect()] == ['"a",1,1.5,2,"TRUE"', '"b"c",2,0.333333333333333,-1,"FALSE"']


def genome(seed=3):
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choices("acgt", k=n))
    unit, other = dna(60), dna(25)

    def copies(u, n):
        return "".join("".join(c if rng.random() > 0.01 else rng.choice("acgt") for c in u) for _ in range(n))

    one = dna(3000) + copies(unit, 60) + dna(3000)
    two = dna(2500) + copies(K.reverse_complement(unit), 50) + dna(2500) + copies(other, 120) + dna(2000)
    return one, two, unit, other


def test_pipeline(spark, tmp_path):
    one, two, unit, other = genome()
    path = tmp_path / "g.fa"
    path.write_text(f">one\n{one}\n>two\n{two}\n")
    cfg = Config(max_repeat=200)
    out = annotate.run(spark, str(path), str(tmp_path / "out"), cfg)
    s = {(r.seqID, r.top_N): r for r in out.summary.collect()}
    assert {(("one", 60)), (("two", 60)), (("two", 25))} <= set(s)
    assert s["one", 60]["class"] == s["two", 60]["class"] != s["two", 25]["class"]
    assert 55 <= s["one", 60].repeats_number <= 63 and 110 <= s["two", 25].repeats_number <= 125
    assert s["one", 60].median_score <= 10
    rows = out.repeats.orderBy("seqID", "arrayID", "start").collect()
    assert all(r.width == r.end - r.start + 1 for r in rows)
    strands = {q: {r.strand for r in rows if r.arrayID == s[q].array_num_ID} for q in s}
    assert len(strands["one", 60]) == 1 and strands["one", 60] != strands["two", 60]
    names = {n.removeprefix("g.fa_") for n in os.listdir(tmp_path / "out")}
    assert names == {"regarrays.csv", "aregarrays.csv", "classarrays.csv", "no_repeats_arrays.csv", "arrays.csv", "repeats.csv", "repeats_with_seq.csv", "arrays.gff", "repeats.gff"}
    (tmp_path / "t.fa").write_text(f">SAT60\n{unit[17:]}{unit[:17]}\n")
    named = annotate.run(spark, str(path), str(tmp_path / "out2"), cfg, str(tmp_path / "t.fa"))
    assert "SAT60" in {r["class"] for r in named.summary.collect()}


def test_result_does_not_depend_on_partitions(spark):
    want = None
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, catalogue.QUERIES["repeat_regions"](spark, SF).collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_streaming(spark, tmp_path):
    one, two, *_ = genome(5)
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("one", one, len(one)), ("two", two, len(two))], "seq_id string, seq string, length long").write.parquet(src)
    stream = spark.readStream.schema("seq_id string, seq string, length long").parquet(src)
    streaming.write_regions(stream, dst, str(tmp_path / "ck"), Config(max_repeat=200)).awaitTermination()
    assert {r.seq_id for r in spark.read.parquet(dst).collect()} == {"one", "two"}


def test_arrays_of_all_periods(spark, tmp_path):
    """The queries on arrays report periods of the whole range of Config, from short and long texts."""
    rng = random.Random(11)

    def text(n):
        return "".join(rng.choices("abcd", k=n))  # mapped to a, c, g and t

    docs = [(period, text(before) + text(period) * copies + text(before)) for period, copies, before in ((30, 20, 500), (90, 6, 200), (150, 6, 40), (400, 8, 1500), (900, 6, 1000))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in catalogue.split_arrays(spark, str(tmp_path)).collect():
        found.setdefault(int(r.seqID), set()).add(r.top_N)
    assert all(period in found.get(period, ()) for period, _ in docs), found
    rows = catalogue.mapped_repeats(spark, str(tmp_path)).collect()
    assert all(sum(int(r.seqID) == period and abs(r.width - period) <= 2 for r in rows) >= 3 for period, _ in docs)

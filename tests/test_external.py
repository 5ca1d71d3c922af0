"""Outside programs, played by small scripts: options, texts in, results out, failures, and a whole run with both."""

import os
import random
import stat
import sys

import pytest

from repeatloom import __main__ as command
from repeatloom.config import Config
from repeatloom.functions import external, kernels

ALIGN = """
rows = [r.split("\\n", 1)[1].replace("\\n", "") for r in ("\\n" + sys.stdin.read()).split("\\n>")[1:]]
assert sys.argv[1:] == ["--infile=-", "--threads=1", "--output-order=input-order"], sys.argv
wide = max(map(len, rows))
for i, r in enumerate(rows):
    r = r.upper().ljust(wide, "-")
    print(f">{i}\\n" + "\\n".join(r[a : a + 7] for a in range(0, wide, 7)))
"""

MAP = """
options, (query, target) = sys.argv[1:-2], sys.argv[-2:]
assert options[:5] == ["--popen", "0.1", "--pextend", "0.8", "--dna"], options
unit, text = (open(p).read().split("\\n")[1] for p in (query, target))
with open(options[options.index("--tblout") + 1], "w") as out:
    out.write("# a table of hits\\n")
    for strand, u in (("+", unit), ("-", unit[::-1].translate(str.maketrans("acgt", "tgca")))):
        at = text.find(u)
        while at >= 0:
            a, b = (at + 1, at + len(u)) if strand == "+" else (at + len(u), at + 1)
            out.write(f"array - unit - 1 {len(u)} {a} {b} {a} {b} {len(text)} {strand} 1e-9 42.5 0.0 -\\n")
            at = text.find(u, at + 1)
"""


def program(folder, name, body):
    path = folder / name
    path.write_text(f"#!{sys.executable}\nimport sys\n{body}")
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_aligner_rows_and_failures(tmp_path):
    align = external.Aligner(program(tmp_path, "align", ALIGN))
    assert align(["acgtacgtac", "acg", "", "tttttttttttt"]) == ["acgtacgtac--", "acg---------", "tttttttttttt"]
    assert align(["", "acg"]) == ["acg"] and align([]) == []
    with pytest.raises(RuntimeError, match="ended with 3: broken"):
        external.Aligner(program(tmp_path, "fails", "sys.stderr.write('broken'); sys.exit(3)"))(["a", "c"])
    with pytest.raises(RuntimeError, match="1 rows for 2"):
        external.Aligner(program(tmp_path, "short", "print('>x\\nacgt')"))(["a", "c"])


def test_mapper_hits_and_open_files(tmp_path):
    find = external.Mapper(program(tmp_path, "map", MAP))
    before = len(os.listdir("/proc/self/fd"))
    assert find("aacg", "ttaacgtt") == [(3, 6, True, 42.5, 1e-9), (5, 8, False, 42.5, 1e-9)]
    assert find("aacg", "tttt") == [] and find("", "tttt") == [] and find("a", "") == []
    with pytest.raises(RuntimeError, match="ended with 1"):
        external.Mapper(program(tmp_path, "fails", "sys.exit(1)"))("acg", "acg")
    assert len(os.listdir("/proc/self/fd")) == before
    long = "ac" * 2_000_000 + "aacg"
    assert find("aacg", long) == [(4_000_001, 4_000_004, True, 42.5, 1e-9)]


def test_hits_table_skips_what_is_no_hit():
    good = "s - q - 1 9 30 12 30 12 99 - 2e-5 17.25 0 -"
    assert external.hits_of("\n".join(["# head", "", "too few fields", good, good.replace("s -", "s#1 -")])) == [(12, 30, False, 17.25, 2e-5)]


def test_kernels_use_what_is_given(tmp_path):
    calls = []

    def align(seqs):
        calls.append(len(seqs))
        return kernels.star_alignment(seqs)

    rng = random.Random(5)
    unit = "".join(rng.choice("acgt") for _ in range(60))
    text = unit * 30
    assert kernels.describe_array(text, Config(max_repeat=200, aligner=align)) == kernels.describe_array(text, Config(max_repeat=200))
    assert calls
    r = kernels.map_repeats(unit, 60, text, 101, Config(mapper=lambda u, t: [(61, 120, False, 3.0, 1e-4), (1, 60, True, 2.0, 1e-3)]))
    assert r.start.tolist() == [101, 161] and r.end.tolist() == [160, 220] and r.plus.tolist() == [True, False]
    assert r.score.tolist() == [2.0, 3.0] and r.eval.tolist() == [1e-3, 1e-4] and r.width.tolist() == [60, 60]
    assert len(kernels.map_repeats(unit, 60, text, 101, Config(mapper=lambda u, t: []))) == 0


def test_whole_run_with_both_programs(spark, tmp_path):
    from repeatloom.plans import annotate

    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    unit = letters(80)
    (tmp_path / "g.fa").write_text(f">one\n{letters(2000)}{unit * 25}{letters(2000)}\n")
    align, find = external.Aligner(program(tmp_path, "align", ALIGN), external.tally(spark)), external.Mapper(program(tmp_path, "map", MAP), external.tally(spark))
    out = annotate.run(spark, str(tmp_path / "g.fa"), str(tmp_path / "out"), Config(max_repeat=200, aligner=align, mapper=find))
    rows = out.repeats.orderBy("start").collect()
    mapped = [r for r in rows if r.eval == 1e-9]  # the others were set by the clean-up of the edges
    assert len(mapped) >= 21 and {r.width for r in mapped} == {80} and rows[2:-2] == mapped
    assert {dna_rotation(r.representative, unit) for r in rows} == {True}
    assert align.calls.value[0] >= 2 and find.calls.value[0] == 1 and align.calls.value[1] >= align.calls.value[2] > 0


def dna_rotation(a, b):
    return len(a) == len(b) and (a in b * 2 or kernels.reverse_complement(a) in b * 2)


def test_command_names_missing_programs(tmp_path, capsys):
    (tmp_path / "g.fa").write_text(">a\nacgt\n")
    given = ["-f", str(tmp_path / "g.fa"), "-o", str(tmp_path / "o"), "--aligner", "no-such-aligner", "--mapper", "no-such-mapper"]
    assert command.main(given) == 2
    err = capsys.readouterr().err
    assert "no-such-aligner" in err and "no-such-mapper" in err and not (tmp_path / "o").exists()

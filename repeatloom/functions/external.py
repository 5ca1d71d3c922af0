"""Outside programs in the place of the built-in aligner and mapper: Config.aligner and Config.mapper take any function of the
same kind, or one of the two classes below. A program runs on the executors, for one array at a time, so each of them must have it.
Texts go through pipes and memory files: nothing is written to a local folder, and a lost executor leaves nothing behind."""

from __future__ import annotations

import os
import subprocess
import time

from pyspark import Accumulator, AccumulatorParam
from pyspark.sql import SparkSession

# Options of the two programs.
ALIGNER_OPTIONS = ("--infile=-", "--threads=1", "--output-order=input-order")
MAPPER_OPTIONS = ("--popen", "0.1", "--pextend", "0.8", "--dna")

Hit = tuple[int, int, bool, float, float]  # start and end (1-based, within the text), on the plus strand, score, e-value


class Tally(AccumulatorParam):
    """(calls, seconds, longest call), merged over tasks; a task that runs twice counts twice."""

    def zero(self, value: tuple) -> tuple:
        return (0, 0.0, 0.0)

    def addInPlace(self, a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], a[1] + b[1], max(a[2], b[2]))


def tally(spark: SparkSession) -> Accumulator:
    return spark.sparkContext.accumulator((0, 0.0, 0.0), Tally())


def rows_of(fasta: str) -> list[str]:
    """The lower-cased sequences of FASTA text, lines joined."""
    return ["".join(record.split("\n")[1:]).replace("\r", "").lower() for record in ("\n" + fasta).split("\n>")[1:]]


def hits_of(table: str) -> list[Hit]:
    """Hits of a white-space table (see sources.fasta.search_hits): lines with a '#' or under 14 fields are skipped."""
    lines = (line.split() for line in table.split("\n") if "#" not in line)
    places = ((sorted((int(f[8]), int(f[9]))), f) for f in lines if len(f) >= 14)
    return [(a, b, f[11] == "+", float(f[13]), float(f[12])) for (a, b), f in places]


class Program:
    """path: of an executable; calls: a tally that its runs are added to. A run that fails raises, so that Spark tries it again."""

    def __init__(self, path: str, calls: Accumulator | None = None):
        self.path, self.calls = path, calls

    def run(self, options: list[str], text: str | None = None, files: tuple[int, ...] = ()) -> str:
        began = time.monotonic()
        given = {"stdin": subprocess.DEVNULL} if text is None else {"input": text}
        done = subprocess.run([self.path, *options], capture_output=True, text=True, pass_fds=files, **given)
        if self.calls is not None:
            took = time.monotonic() - began
            self.calls.add((1, took, took))
        if done.returncode:
            raise RuntimeError(f"{self.path} ended with {done.returncode}: {done.stderr[-500:]}")
        return done.stdout


class Aligner(Program):
    """sequences -> rows of one length, as `clustalo` gives them. Empty sequences have no row; a single one is its own alignment."""

    def __call__(self, sequences: list[str]) -> list[str]:
        own = [s for s in sequences if s]
        if len(own) < 2:
            return own
        rows = rows_of(self.run(list(ALIGNER_OPTIONS), "".join(f">{i}\n{s}\n" for i, s in enumerate(own))))
        if len(rows) != len(own) or len({len(r) for r in rows}) != 1:
            raise RuntimeError(f"{self.path} gave {len(rows)} rows for {len(own)} sequences, or rows of several lengths")
        return rows


class Mapper(Program):
    """(unit, text) -> hits, as `nhmmer` writes them to its table."""

    def __call__(self, unit: str, text: str) -> list[Hit]:
        if not unit or not text:
            return []
        opened: list[int] = []

        def memory(content: str) -> str:
            opened.append(os.memfd_create("repeatloom"))
            with open(opened[-1], "wb", closefd=False) as out:
                out.write(content.encode())
            return f"/dev/fd/{opened[-1]}"

        try:
            table, query, target = memory(""), memory(f">unit\n{unit}\n"), memory(f">array\n{text}\n")
            self.run([*MAPPER_OPTIONS, "--tblout", table, query, target], files=tuple(opened))
            with open(opened[0], "rb", closefd=False) as found:
                found.seek(0)
                return hits_of(found.read().decode())
        finally:
            for fd in opened:
                os.close(fd)


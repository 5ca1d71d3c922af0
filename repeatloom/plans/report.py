"""Progress of a run: sections with elapsed time, the genome, regions, classes and files, as log records."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.operators.arrays import class_breakdown

LONGEST, CLASSES = 10, 8  # rows of the listings


def percent(part: float, whole: float) -> str:
    return f"{100 * part / whole if whole else 0:.1f}%"


def span(bases: float) -> str:
    for unit, name, digits in ((1_000_000, "Mbp", 2), (1000, "kbp", 1)):
        if bases >= unit:
            return f"{bases / unit:.{digits}f}{name}"
    return f"{bases:g}bp"


def elapsed(seconds: float) -> str:
    """Seconds with a decimal up to a minute, then minutes and seconds, then hours and minutes."""
    if seconds < 60:
        return f"{seconds:.1f}s"
    big, small, names = (seconds, 1, "ms") if seconds < 3600 else (seconds / 60, 1, "hm")
    whole, rest = divmod(int(big), 60)
    return f"{whole}{names[0]}{rest:02d}{names[1]}"


class Progress:
    """Each listing is a bounded aggregate; silent() runs none of them."""

    def __init__(self, source: str, target: str, on: bool = True):
        self.began, self.on, self.log = time.monotonic(), on and logging.getLogger("repeatloom").isEnabledFor(logging.INFO), logging.getLogger("repeatloom")
        self.say(f"{source} to {target}")

    @classmethod
    def silent(cls) -> "Progress":
        return cls("", "", on=False)

    def say(self, text: str) -> None:
        if self.on:
            self.log.info(text)

    def warn(self, text: str) -> None:
        self.log.warning(text)

    def section(self, title: str) -> None:
        self.say(f"==> {title} [{elapsed(time.monotonic() - self.began)}]")

    def count(self, table: DataFrame, what: str) -> None:
        if self.on:
            n = table.count()
            self.say(f"{n:,} {what}{'' if n == 1 else 's'}")

    def program(self, program) -> None:
        """Runs of an outside program, where it counts them."""
        calls = getattr(program, "calls", None)
        if self.on and calls is not None:
            n, seconds, longest = calls.value
            self.say(f"{program.path}: {n:,} runs, {elapsed(seconds)} in all, longest {elapsed(longest)}")

    def genome(self, sequences: DataFrame) -> None:
        if self.on:
            n, bases = sequences.agg(F.count(F.lit(1)), F.sum("length")).first()
            for r in sequences.select("seq_id", "length").orderBy(F.col("length").desc(), "seq_id").limit(LONGEST).collect():
                self.say(f"{r.seq_id}  {r.length:,} bp")
            if n > LONGEST:
                self.say(f"({n - LONGEST:,} more)")
            self.say(f"{n:,} sequences, {bases:,} bp ({span(bases)})")

    def regions(self, regions: DataFrame, sequences: DataFrame) -> None:
        if self.on:
            n, covered = regions.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0))).first()
            whole = sequences.agg(F.sum("length")).first()[0]
            self.say(f"{n:,} repetitive regions, {covered:,} bp ({percent(covered, whole)} of the input)")

    def classes(self, arrays: DataFrame) -> None:
        if self.on:
            known = arrays.where("class != 'none_identified'")
            n, of = known.agg(F.count(F.lit(1)), F.count_distinct("class")).first()
            self.say(f"{of:,} classes; {n:,} arrays classified, {arrays.count() - n:,} unclassified")
            for r in class_breakdown(known, CLASSES).collect():
                self.say(f"{r['class']}: {r.arrays:,} arrays, median unit {span(r.median_length)}, {span(r.span)}")

    def files(self, paths: list[str]) -> None:
        """The manifest."""
        for path in paths:
            self.say(path)
        self.say(f"{len(paths)} tables, done in {elapsed(time.monotonic() - self.began)}")

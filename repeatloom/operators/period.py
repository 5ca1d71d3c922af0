"""Periods from distances between equal k-mers: inverted index, distance histograms, moving mode, merged runs, top five."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions import scan


def _words(part: str, at: np.ndarray, k: int) -> pa.Array:
    """The k-mers at these places of a piece."""
    raw = scan.codes(part)
    flat = raw[(at[:, None] + np.arange(k)).ravel()] if len(at) else raw[:0]
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.arange(0, (len(at) + 1) * k, k, dtype=np.int32)), pa.py_buffer(flat.tobytes())])


def each(sequences: DataFrame, names: list[str], types: list[str], rows) -> DataFrame:
    """rows(text) yields lists of columns; seq_id goes before them. One pass over each sequence, no shuffle."""
    kind = sequences.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: list[list] = []

            def flush() -> pa.RecordBatch:
                cols = [np.concatenate(c) if isinstance(c[0], np.ndarray) else pa.concat_arrays(c) for c in zip(*done)]
                done.clear()
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *map(pa.array, cols[1:])], names=["seq_id", *names])

            held = 0
            for i, text in enumerate(b.column(1)):
                for cols in rows(text.as_py() or ""):
                    if n := len(cols[0]):
                        done.append([np.full(n, i), *cols])
                        held += n
                    if held >= 10_000:  # a batch for each short text would take longer than its rows
                        yield flush()
                        held = 0
            if done:
                yield flush()

    return sequences.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def kmer_positions(sequences: DataFrame, k: int, begins: str = "", ends: str = "") -> DataFrame:
    """seq_id, kmer, pos: every k-mer without n (that begins and ends so), positions from 1."""

    def rows(text: str):
        for a, at, _, part in scan.kmer_places(text, k):
            raw = scan.codes(part)
            for j, c in [*enumerate(begins), *((k - len(ends) + j, c) for j, c in enumerate(ends))]:
                at = at[raw[at + j] == ord(c)]
            yield [_words(part, at, k), a + at + 1]

    return each(sequences, ["kmer", "pos"], ["string", "long"], rows)


def kmer_intervals(sequences: DataFrame, k: int, begins: str = "", ends: str = "") -> DataFrame:
    """seq_id, start, end of kmer_positions, with before, after and mean_width (intervals.beside). A piece's places are put in order
    within it and the last one waits for the next piece, so nothing is shuffled or sorted and a task holds one piece."""

    def rows(text: str):
        held, before = np.zeros(0, np.int64), -1
        for a, at, _, part in scan.kmer_places(text, k):
            raw = scan.codes(part)
            for j, c in [*enumerate(begins), *((k - len(ends) + j, c) for j, c in enumerate(ends))]:
                at = at[raw[at + j] == ord(c)]
            if len(at):
                start = np.append(held, a + np.sort(at) + 1)
                yield columns(start[:-1], start[1:], before)
                if len(start) > 1:
                    before = int(start[-2]) + k - 1
                held = start[-1:]
        if len(held):
            yield columns(held, None, before)

    def columns(start: np.ndarray, after: np.ndarray | None, before: int) -> list:
        n = len(start)
        prior = np.append(before, start[:-1] + k - 1)[:n]
        nexts = pa.nulls(n, pa.int64()) if after is None else pa.array(after)
        return [start, start + k - 1, pa.array(prior, mask=prior < 0), nexts, np.full(n, float(k))]

    return each(sequences, ["start", "end", "before", "after", "mean_width"], ["long", "long", "long", "long", "double"], rows)


def kmer_counts(sequences: DataFrame, k: int, least: int = 2) -> DataFrame:
    """seq_id, kmer, n, first, last of k-mers that occur often enough. Each piece of a sequence counts its own; only sequences of
    several pieces are summed up in a shuffle."""

    def rows(text: str):
        whole = len(text) <= scan.PIECE
        for a, at, ids, part in scan.kmer_places(text, k):
            head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
            n = np.diff(np.append(head, len(ids)))
            last = head + n - 1
            if whole:
                head, last, n = (x[n >= least] for x in (head, last, n))
            yield [_words(part, at[head], k), n, a + at[head] + 1, a + at[last] + 1]

    names, types = ["kmer", "n", "first", "last"], ["string", "long", "long", "long"]
    short = each(sequences.where(F.length("seq") <= scan.PIECE), names, types, rows)
    long = each(sequences.where(F.length("seq") > scan.PIECE), names, types, rows)
    summed = long.groupBy("seq_id", "kmer").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).where(F.col("n") >= least)
    return short.unionByName(summed)


def frequent_kmers(counts: DataFrame) -> DataFrame:
    """The adaptive cut, by the number of the sequence's repeated k-mers: with a threshold (a thousandth of it and one) above 2,
    k-mers from the threshold on are kept, 5000 at most, or, if none reaches it, the most frequent tenth. Order: most frequent
    first, then by name."""
    rank = Window.partitionBy("seq_id").orderBy(F.col("n").desc(), "kmer")
    every = Window.partitionBy("seq_id")
    t = counts.withColumns({"rank": F.row_number().over(rank), "total": F.count(F.lit(1)).over(every), "most": F.max("n").over(every)})
    t = t.withColumn("need", F.floor(F.col("total") / 1000) + 1)
    often = F.when(F.col("most") >= F.col("need"), (F.col("n") >= F.col("need")) & (F.col("rank") <= 5000)).otherwise(F.col("rank") <= F.ceil(F.col("total") / 10))
    return t.where((F.col("need") <= 2) | often).select("seq_id", "kmer", "n", F.col("rank").cast("long").alias("rank"))


def distances(sequences: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """seq_id, kmer, pos, dist: from each occurrence to the next one of the same k-mer, where it is a possible period. The next
    one lies within most characters, so pieces that overlap by that much need no shuffle, and no k-mer is a hot key."""

    def rows(text: str):
        for a, at, gap, part in scan.next_distances(text, k, least, most):
            yield [_words(part, at, k), a + at + 1, gap]

    return each(sequences, ["kmer", "pos", "dist"], ["string", "long", "long"], rows)


def distance_windows(dist: DataFrame, sequences: DataFrame, size: int = 1000, step: int = 100) -> DataFrame:
    """The first of the overlapping windows (every step, size long, cut at the end) that covers each pair's left end, in closed form."""
    t = dist.join(sequences.select("seq_id", "length"), "seq_id")
    number = F.greatest(F.lit(1), F.floor((F.col("length") - step - 1) / F.lit(step)) + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - 1 - (size - 1)) / F.lit(step)))
    return t.withColumn("win", F.least(number - 1, first).cast("long")).drop("length")


def moving_mode(windowed: DataFrame, more_than: int = 10) -> DataFrame:
    """seq_id, win, pairs, period: the most frequent distance of each window with enough pairs; of ties the smallest."""
    c = windowed.groupBy("seq_id", "win", "dist").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("seq_id", "win")
    c = c.withColumns({"pairs": F.sum("n").over(by), "rank": F.row_number().over(by.orderBy(F.col("n").desc(), "dist"))})
    return c.where((F.col("rank") == 1) & (F.col("pairs") > more_than)).select("seq_id", "win", "pairs", F.col("dist").alias("period"))


def period_runs(modes: DataFrame) -> DataFrame:
    """seq_id, first_period, names, n, total: periods one apart are merged; names are joined by commas, counts summed."""
    c = modes.groupBy("seq_id", "period").agg(F.count(F.lit(1)).alias("n"))
    run = F.col("period") - F.row_number().over(Window.partitionBy("seq_id").orderBy("period"))
    return c.withColumn("run", run).groupBy("seq_id", "run").agg(
        F.min("period").alias("first_period"), F.expr("listagg(cast(period as string), ',') within group (order by period)").alias("names"), F.sum("n").alias("n"), F.floor(F.avg("period")).alias("mean_period")
    ).drop("run")


def top_periods(runs: DataFrame, most: int = 5) -> DataFrame:
    """seq_id, top_n (floor of the mean of the winning run), top_5 (N_<names>_Count_<n>. for each of the first five)."""
    by = Window.partitionBy("seq_id").orderBy(F.col("n").desc(), "first_period")
    r = runs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    item = F.format_string("N_%s_Count_%d.", "names", "n")
    return r.withColumn("item", item).groupBy("seq_id").agg(F.max(F.when(F.col("rank") == 1, F.col("mean_period"))).alias("top_n"), F.expr("listagg(item, '') within group (order by rank)").alias("top_5"))

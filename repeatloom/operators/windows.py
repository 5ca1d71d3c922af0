"""Tiled windows, the singleton score, and repetitive regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions import scan


def tiles(sequences: DataFrame, size: int) -> DataFrame:
    """seq_id, length, win_idx, start, end: windows of size from 1, size + 1, ...; the last begins before length - size, and each ends size further on at most.

    Sequences shorter than the tile give no window. Texts are not read."""
    n = F.col("length")
    number = F.greatest(F.lit(1), F.ceil((n - size) / F.lit(size))).cast("int")
    return (
        sequences.where(n >= size)
        .select("seq_id", "length", F.explode(F.sequence(F.lit(0), number - 1)).alias("win_idx"))
        .select("seq_id", "length", F.col("win_idx").cast("long").alias("win_idx"), (F.col("win_idx") * size + 1).cast("long").alias("start"), (F.col("win_idx") * size + size).cast("long").alias("end"))
    )


def kmer_totals(sequences: DataFrame, size: int, k: int) -> DataFrame:
    """The tiles with total (k-mers without n) and singles (those that occur once in the window).

    A window's k-mers concern it alone, so they are counted in one pass over each sequence and no k-mer is ever a row."""
    kind = sequences.schema["seq_id"].dataType.simpleString()
    names = ["seq_id", "length", "win_idx", "start", "end", "total", "singles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: list[tuple] = []

            def flush() -> pa.RecordBatch:
                which, length, at, total, singles = map(np.concatenate, zip(*done))
                done.clear()
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), *map(pa.array, (length, at, at * size + 1, at * size + size, total, singles))], names=names)

            held = 0
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                total, singles = scan.window_totals(text, size, k)
                if n := len(total):
                    done.append((np.full(n, i), np.full(n, len(text)), np.arange(n), total, singles))
                    held += n
                if held >= 10_000:  # a batch for each short text would take longer than its windows
                    yield flush()
                    held = 0
            if done:
                yield flush()

    return sequences.where(F.col("length") >= size).select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, length long, win_idx long, start long, end long, total long, singles long")


def singleton_score(totals: DataFrame, k: int) -> DataFrame:
    """The percentage of k-mers that occur once: low is repetitive. 100 where fewer than 2k k-mers count."""
    few = (F.col("total") < 2 * k) | (F.col("end") - F.col("start") <= k)
    return totals.withColumn("score", F.when(few, 100.0).otherwise(F.col("singles") * 100.0 / F.col("total")))


def regions(scores: DataFrame, size: int, low: float) -> DataFrame:
    """seq_id, start, end, score, windows: neighbouring repetitive windows merged.

    A repetitive window reaches one window past its own end (the last one to the sequence's end), so windows merge when at
    most one lies between them. The score is folded in order: each step weighs the region so far against the next window
    by their reach. The last window follows from the length, so only repetitive windows are shuffled."""
    by = Window.partitionBy("seq_id").orderBy("win_idx")
    last = F.greatest(F.lit(1), F.ceil((F.col("length") - size) / F.lit(size))) - 1
    hits = (
        scores.where(F.col("score") < low).withColumn("last", last)
        .withColumn("reach", F.when(F.col("win_idx") == F.col("last"), F.col("length")).otherwise(F.least(F.col("start") + 2 * size - 1, F.col("length"))))
        .withColumn("new", F.coalesce((F.col("win_idx") - F.lag("win_idx").over(by) > 2).cast("int"), F.lit(0)))
        .withColumn("island", F.sum("new").over(by))
    )
    members = F.array_sort(F.collect_list(F.struct("start", "reach", "score")))
    first = F.element_at("w", 1)
    state = F.struct(first["start"].alias("start"), first["reach"].alias("end"), first["score"].cast("double").alias("score"))

    def fold(a, w):
        mine, its = (a["end"] - a["start"]).cast("double"), (w["reach"] - w["start"]).cast("double")
        return F.struct(a["start"].alias("start"), w["reach"].alias("end"), ((a["score"] * mine + w["score"] * its) / (mine + its)).alias("score"))

    return (
        hits.groupBy("seq_id", "island").agg(members.alias("w"))
        .select("seq_id", F.aggregate(F.slice("w", 2, F.size("w")), state, fold).alias("r"), F.size("w").cast("long").alias("windows"))
        .select("seq_id", "r.start", "r.end", "r.score", "windows")
    )

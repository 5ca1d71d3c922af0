"""Texts of intervals of long sequences. Sequences are cut into pieces once; intervals meet only the pieces that they cover,
so no whole sequence is joined, copied or sent for an interval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16


def pieces(sequences: DataFrame) -> DataFrame:
    """seq_id (string), piece (from 0), text: each sequence in pieces of PIECE characters, in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                for a in range(0, len(text), 64 * PIECE):
                    parts = [text[x : x + PIECE] for x in range(a, min(a + 64 * PIECE, len(text)), PIECE)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array(range(a // PIECE, a // PIECE + len(parts)), pa.int64()), pa.array(parts)], names=["seq_id", "piece", "text"])

    return sequences.select(F.col("seq_id").cast("string"), "seq").mapInArrow(run, "seq_id string, piece long, text string")


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df's rows (so many) dealt to tasks of a few hundred each, and to all cores if there are fewer: short texts take long in a
    kernel, so their bytes are no measure, by which Spark would put them into one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(rows, max(4 * cores, -(-rows // 400)), 20_000)))


def texts(intervals: DataFrame, cut: DataFrame, seq_id: str, start: Column, end: Column, name: str) -> DataFrame:
    """intervals with their text, 1-based and inclusive, as column name; cut is pieces(). Intervals are rows of a written table or
    otherwise the same when read again; those of an unknown sequence get null. Only columns of simple types are carried."""
    t = intervals.withColumns({"_a": start.cast("long") - 1, "_b": end.cast("long")})
    covered = t.withColumn("piece", F.explode(F.when(F.col("_b") > F.col("_a"), F.sequence(F.floor(F.col("_a") / PIECE), F.floor((F.col("_b") - 1) / PIECE))).otherwise(F.array().cast("array<bigint>"))))
    met = covered.join(cut.withColumnRenamed("seq_id", "_seq"), (F.col(seq_id).cast("string") == F.col("_seq")) & (covered["piece"] == cut["piece"])).drop(cut["piece"])
    base = F.col("piece") * PIECE
    part = F.substring("text", (F.greatest(F.col("_a") - base, F.lit(0)) + 1).cast("int"), (F.least(F.col("_b") - base, F.lit(PIECE)) - F.greatest(F.col("_a") - base, F.lit(0))).cast("int"))
    met = met.select(*intervals.columns, F.struct("piece", part.alias("part")).alias("_part"))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["part"]))
    return met.groupBy(*intervals.columns).agg(whole.alias(name))

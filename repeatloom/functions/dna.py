"""DNA strings as column expressions, evaluated in the JVM, and the DNA view of a table of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of ordinary text dealt over the four bases in turn; z becomes n.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtan"


def from_text(text: Column) -> Column:
    """The DNA view of a text: its letters a-z mapped to bases."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


def view(docs: DataFrame, seq_id: str, text: str) -> DataFrame:
    """seq_id, seq: from_text of a column in one Arrow pass, in a third of the time; for whole tables of long texts."""
    table, drop = bytes.maketrans(LETTERS.encode(), BASES.encode()), bytes(x for x in range(256) if chr(x) not in LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                seqs = [None if t is None else t.encode().translate(table, drop).decode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seqs, pa.string())], names=["seq_id", "seq"])

    return docs.select(seq_id, F.lower(F.col(text))).mapInArrow(run, f"seq_id {docs.schema[seq_id].dataType.simpleString()}, seq string")


def complement(s: Column) -> Column:
    return F.translate(s, "acgtn", "tgcan")


def reverse_complement(s: Column) -> Column:
    """Lower-case a c g t n are paired; other characters pass through."""
    return F.reverse(complement(s))


def positions(n: Column) -> Column:
    """1 to n as an array, empty for n < 1 (sequence alone would count down)."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def kmers(s: Column, k: int) -> Column:
    """The length - k k-mers that count in scores: the last one is left out throughout this model."""
    return F.transform(positions(F.length(s) - k), lambda i: F.substring(s, i, F.lit(k)))


def circular_kmers(s: Column, k: int) -> Column:
    """One k-mer from each position of the circle."""
    ring = F.repeat(s, F.lit(1) + F.ceil(F.lit(k) / F.greatest(F.length(s), F.lit(1))).cast("int"))
    return F.transform(positions(F.length(s)), lambda i: F.substring(ring, i, F.lit(k)))


def rotations(s: Column) -> Column:
    """All rotations, the string itself first."""
    return F.transform(positions(F.length(s)), lambda i: F.concat(F.substring(s, i, F.length(s)), F.substring(s, F.lit(1), i - 1)))


def both_strands(s: Column) -> Column:
    """Rotations by 1, 2, ..., all letters (the string itself), then the reverse complement of each."""
    turned = F.transform(positions(F.length(s)), lambda i: F.concat(F.substring(s, i + 1, F.length(s)), F.substring(s, F.lit(1), i)))
    return F.concat(turned, F.transform(turned, reverse_complement))


def least_rotation(s: Column) -> Column:
    return F.coalesce(F.array_min(rotations(s)), s)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings of one length."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(differ, F.lit(0), lambda n, d: n + d)


def count_of(s: Column, base: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))).cast("long")

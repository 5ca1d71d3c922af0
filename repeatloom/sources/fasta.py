"""FASTA sources: a reader, unique names, templates, and search-hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """num_id, name, seq, length: records in file order. Names are the header's first word ('' if blank); text before the
    first header is ignored; sequences are lower-cased and keep their codes. A .gz suffix is decompressed by the reader.

    The reader itself splits at a '>' that begins a line, so a file of any size is read in parallel and a record is a row.
    One file a call: the order of records is that of the file's splits."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("split", F.shiftright("at", 33))
    first = F.col("at") == 0  # what comes before the first line break and '>'
    junk = first & ~F.col("value").startswith(">")
    # records before each split: one narrow row for each split, so numbering moves no sequence
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max(junk.cast("int")).alias("junk"))
    every = Window.orderBy("split")
    before = counts.select("split", (F.sum("n").over(every) - F.col("n") - F.sum("junk").over(every)).alias("before"))
    rows = rows.join(F.broadcast(before), "split").where(~junk).withColumn("num_id", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    rows = rows.withColumn("record", F.regexp_replace(F.when(first, F.expr("substring(value, 2)")).otherwise(F.col("value")), "\r", ""))
    head = F.substring_index("record", "\n", 1)
    return rows.select(
        F.col("num_id").cast("long").alias("num_id"),
        F.coalesce(F.regexp_extract(head, r"^\s*(\S+)", 1), F.lit("")).alias("name"),
        F.lower(F.regexp_replace(F.expr("substring(record, length(substring_index(record, '\n', 1)) + 1)"), "\n", "")).alias("seq"),
    ).withColumn("length", F.length("seq").cast("long"))


def unique_names(table: DataFrame) -> DataFrame:
    """seq_id: a name that occurs once stays; repeated names get 1, 2, ... in order of num_id (unique). Only names and numbers are
    shuffled; the rows meet their own by num_id."""
    by = Window.partitionBy("name")
    number = F.row_number().over(by.orderBy("num_id")).cast("string")
    named = table.select("num_id", "name").withColumn("seq_id", F.when(F.count(F.lit(1)).over(by) > 1, F.concat("name", number)).otherwise(F.col("name")))
    return table.join(named.select("num_id", "seq_id"), "num_id") if set(table.columns) - {"num_id", "name"} else named


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """num_id, seq_id, seq, length."""
    return unique_names(read(spark, path)).select("num_id", "seq_id", "seq", "length")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, place (in the file); an empty file is an error."""
    out = read(spark, path).select("name", "seq", F.col("num_id").alias("place"))
    if out.isEmpty():
        raise ValueError(f"no template in {path}")
    return out


def search_hits(spark: SparkSession, path: str, seq_id: str, array_id: int) -> DataFrame:
    """Rows of a white-space table of nucleotide profile hits: columns 9, 10, 12, 13 and 14 are the envelope, strand, e-value and
    score. Lines with a '#' or with fewer than 14 fields are skipped; on '-' the envelope is turned round."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").contains("#")).select(f.alias("f")).where(F.size("f") >= 14)
    a, b = F.col("f")[8].cast("long"), F.col("f")[9].cast("long")
    return rows.select(
        F.lit(seq_id).alias("seqID"), F.lit(array_id).cast("long").alias("arrayID"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"),
        F.col("f")[11].alias("strand"), F.col("f")[13].cast("double").alias("score"), F.col("f")[12].cast("double").alias("eval"),
    )

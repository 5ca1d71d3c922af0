"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after each run of ASCII white space becomes one space. Misra-Gries summaries
(COUNTERS counters in each task, merged by adding) name every digest that can hold more than 1 in COUNTERS rows; a
counting pass over just these verifies them and finds their winners. The winners (at most COUNTERS * 2 rows, so a proven
bound) are broadcast, and copies of frequent texts are settled where they are read. The other digests are shuffled
in the ordinary way: no group there holds more than 1 in COUNTERS rows.

Of equal texts the row with the smallest id stays (nulls last; where no id is set, keep_id is null); of rows that repeat
both id and text, one stays. Null text counts as empty. Extra columns are kept by `unique`. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repeatloom.llm import common

COUNTERS = 512


def normal_digest(text: Column) -> Column:
    """SHA-256, as lowercase hex, of the normalised text in UTF-8."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+", " "), 256)


class MisraGries:
    """Counters for at most k keys; a key's count is short by at most rows / (k + 1)."""

    def __init__(self, k: int):
        self.k, self.counts = k, {}

    def add(self, keys) -> None:
        counts, k = self.counts, self.k
        for key in keys:
            if key in counts:
                counts[key] += 1
            elif len(counts) < k:
                counts[key] = 1
            else:
                for other in [x for x in counts if counts[x] == 1]:
                    del counts[other]
                for other in counts:
                    counts[other] -= 1


def frequent(df: DataFrame, key: str, k: int = COUNTERS) -> DataFrame:
    """key: each value that more than 1 in k rows have is among them; there are at most 2 * k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, n = MisraGries(k), 0
        for b in batches:
            summary.add(b.column(0).to_pylist())
            n += len(b)
        rows = [x for x in summary.counts.items()] + [(None, n)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["key", "n"])

    # Summaries merge by adding: a key over 1 in k of all rows keeps a positive count in some task's summary, and its
    # sum is short by at most rows / (k + 1). The null key carries the number of rows.
    sums = df.select(key).mapInArrow(common.tidy(run), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    best = sums.orderBy(F.col("key").isNull().desc(), F.col("n").desc(), "key").limit(2 * k + 1)  # the row count, then the largest sums
    return best.where("key is not null").select(F.col("key").alias(key), F.col("n").alias("at_least"))


def winners(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size and keep_row of each text that more than 1 in COUNTERS rows have; rows(id, digest, row) are read
    three times, not shuffled. A local table of at most 2 * COUNTERS rows, safe to broadcast at any size of the corpus."""
    spark = rows.sparkSession
    total = rows.count()
    named = spark.createDataFrame(frequent(rows, "digest").select("digest").collect(), "digest string")
    found = rows.join(F.broadcast(named), "digest").groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("keep_row"))
    verified = found.where(F.col("group_size") * COUNTERS > total)
    return F.broadcast(spark.createDataFrame(verified.collect(), verified.schema))


def decide(df: DataFrame, digest: Column, id: Column) -> DataFrame:
    """id, digest, keep_id, group_size, kept; one row for each row of df."""
    # rows are numbered once, in the written table, so that rows which repeat both id and digest can be told apart
    rows = common.materialise(df.select(id.alias("id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "dedup-rows")
    heads = winners(rows)
    heavy = rows.join(heads, "digest").select("id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    group = Window.partitionBy("digest")
    settled = rows.join(heads.select("digest"), "digest", "left_anti").select(
        "id", "digest", F.min("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("id").asc_nulls_last(), "row")) == 1).alias("kept"),
    )
    return heavy.unionByName(settled)


def unique(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """df's rows and columns without the copies. Copies of frequent texts go where they are read; the other rows are shuffled once, by digest."""
    rows = df.withColumn("_dedup_digest", normal_digest(df[text]))
    keys = common.materialise(rows.select(F.col(id).alias("id"), F.col("_dedup_digest").alias("digest"), F.lit(0).alias("row")), "dedup-keys")
    heads = winners(keys).select(F.col("digest").alias("_dedup_digest"), F.col("keep_id").alias("_dedup_keep"), F.lit(True).alias("_dedup_heavy"))
    left = rows.join(heads, "_dedup_digest", "left").where(F.col("_dedup_heavy").isNull() | F.col(id).eqNullSafe(F.col("_dedup_keep")))
    group = Window.partitionBy("_dedup_digest").orderBy(F.col(id).asc_nulls_last())
    out = left.withColumn("_dedup_row", F.row_number().over(group)).where("_dedup_row = 1")
    common.discard(keys)
    return out.select(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = decide(docs, normal_digest(F.col("text")), F.col("doc_id"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t
"""

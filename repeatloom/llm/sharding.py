"""Minimax contiguous partition of whole groups into shards (DataFrame functions only).

Groups (equal texts) are ordered by their SHA-256 and never cut. The smallest capacity at which a greedy fill needs no
more than the wanted number of shards is found by search over [lower, upper]; each pass checks many capacities at once
(each check is one greedy fill: as many look-ups of a prefix sum as there are shards), which is binary search with
several halvings a pass. The cuts of the smallest feasible capacity are the shards.

Nothing gathers a group or the corpus: rows become (group, salt) chunks by a map-side combined aggregate, prefix sums
run within ranges of the digest, the ranges' own sums (one row for PER_RANGE rows of the corpus) are added in front, and the look-ups
are aggregates over the chunk table, restricted to the byte windows in which a cut can lie, which the sorted files prune.

Null text: size 1, CRC of no bytes, in a group with the empty texts. Null or repeated ids keep their rows: the slot
orders by id (nulls first) within a chunk, repeats in any order. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repeatloom.llm import common

PER_RANGE, LEAST_RANGES = 50_000, 256  # ranges of the digest with a prefix sum each follow the rows
PER_SALT, LEAST_SALTS = 500_000, 128  # so do the chunks into which a group's rows are dealt
CHECKS = 255  # capacities checked in one pass: eight halvings


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """ends(end): each group's prefix sum in order. The smallest capacity and, at it, the sums at which shards end."""

    def fill(capacities: list[int]) -> list[list[int]]:
        cuts = [[] for _ in capacities]
        for _ in range(shards):
            open_ = [k for k, c in enumerate(cuts) if not c or c[-1] < total]
            if not open_:
                break
            reach = [min(total, (cuts[k][-1] if cuts[k] else 0) + capacities[k]) for k in open_]
            # a cut lies within one group's size below its reach
            near = ends.where((F.col("end") > min(reach) - largest - 1) & (F.col("end") <= max(reach)))
            steps = sorted(set(reach))
            after = F.size(F.filter(F.lit(steps), lambda r: r < F.col("end")))  # the first reach that takes in this end
            most, best = dict(near.groupBy(after.alias("k")).agg(F.max("end")).collect()), {}
            for i, r in enumerate(steps):
                best[r] = max(most.get(i, 0), best[steps[i - 1]] if i else 0)
            for k, r in zip(open_, reach):
                cuts[k].append(best[r])
        return cuts

    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    best: list[int] | None = None
    if (cuts := fill([low])[0])[-1] >= total:
        return low, cuts
    while low < high:  # low is infeasible, high feasible
        width = high - low
        tries = sorted({low + max(1, width * k // (CHECKS + 1)) for k in range(1, CHECKS + 1)} | ({high} if best is None and width <= CHECKS else set()))
        tries = [t for t in tries if t < high or best is None]
        if not tries:
            break
        found = fill(tries)
        ok = [k for k, c in enumerate(found) if c[-1] >= total]
        if ok:
            high, best = tries[ok[0]], found[ok[0]]
            low = tries[ok[0] - 1] if ok[0] else low
        else:
            low = tries[-1]
        if high - low <= 1:
            break
    return high, best if best is not None else fill([high])[0]


def shard(df: DataFrame, size: Column, group: Column, id: Column, shards: int = 8, extra: dict[str, Column] | None = None) -> DataFrame:
    """id, size, the extra columns, shard (0 to shards - 1), slot (gapless from 0 in each shard). Groups stay whole."""
    spark = df.sparkSession
    rows = common.materialise(
        df.select(id.alias("id"), size.cast("long").alias("size"), group.alias("group"), *[c.alias(k) for k, c in (extra or {}).items()]),
        "shard-rows",
    )
    n = rows.count()
    bits = min(24, max(LEAST_RANGES, -(-n // PER_RANGE)).bit_length())
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(LEAST_SALTS, -(-n // PER_SALT)))).cast("int"))
    bucket = F.shiftright(F.conv(F.substring(F.hex("group"), 1, 6), 16, 10).cast("int"), 24 - bits)
    chunks = rows.groupBy("group", "salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("range", bucket)
    inside = Window.partitionBy("range").orderBy("group", "salt")
    # sums of this chunk and those before it in its range; last: the group ends here
    chunks = common.materialise(
        chunks.withColumns(
            {
                "bytes_to": F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                "n_to": F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                "next": F.lead("group").over(inside),
            }
        ).withColumn("last", F.col("next").isNull() | (F.col("next") != F.col("group"))).drop("next"),
        "shard-chunks",
    )
    sums = chunks.groupBy("range").agg(F.sum("bytes").alias("range_bytes"), F.sum("n").alias("range_n"))
    front = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sums.select("range", F.coalesce(F.sum("range_bytes").over(front), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("range_n").over(front), F.lit(0)).alias("n_before"))
    placed = chunks.join(F.broadcast(base), "range").select(
        "group", "salt", "range", "bytes", "n", "last", (F.col("bytes_before") + F.col("bytes_to")).alias("end"), (F.col("n_before") + F.col("n_to")).alias("n_end")
    )
    groups = placed.groupBy("range", "group").agg(F.sum("bytes").alias("group_bytes"), F.max("end").alias("end"), F.max("n_end").alias("n_end"))
    ends = common.materialise(groups.select("group", "group_bytes", "end", "n_end", "range").sortWithinPartitions("end"), "shard-ends")
    total, largest = ends.agg(F.max("end"), F.max("group_bytes")).first()
    cuts = smallest_capacity(ends, total, largest, shards)[1] if total else []
    # rows before each shard: the count at its first group's front
    starts = [0] + [r["n_end"] for r in ends.where(F.col("end").isin(cuts)).orderBy("end").select("n_end").collect()] if cuts else [0]
    which = F.lit(0)
    for c in cuts[:-1]:
        which = which + (F.col("end") > c).cast("int")  # of the chunk: its group lies on one side of a cut
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard") + 1)
    target = common.materialise(
        placed.withColumn("shard", which).select("group", "salt", "shard", (F.col("n_end") - F.col("n") - first).alias("before")), "shard-target"
    )
    common.discard(chunks, ends)
    within = Window.partitionBy("group", "salt").orderBy(F.col("id").asc_nulls_first())
    return rows.join(target, ["group", "salt"]).select(
        "id", "size", *(extra or {}), "shard", (F.col("before") + F.row_number().over(within) - 1).alias("slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by bytes."""
    docs = common.documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = shard(docs, F.octet_length(text) + 1, F.unhex(F.sha2(text, 256)), F.col("doc_id"), 8, {"text_crc32": F.crc32(text.cast("binary"))})
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

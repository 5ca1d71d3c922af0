"""Neighbour relations of intervals on a sequence, and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(rows: DataFrame, by: str = "seq_id") -> DataFrame:
    """rows(start, end) with before (end of the interval before), after (start of the next one; null for the last) and mean_width of
    the sequence. What has these columns already (period.kmer_intervals: found in one pass, without a sort) is returned as it is."""
    if {"before", "after", "mean_width"} <= set(rows.columns):
        return rows
    order, every = Window.partitionBy(by).orderBy("start", "end"), Window.partitionBy(by)
    width = F.avg(F.col("end") - F.col("start") + 1).over(every)
    return rows.withColumns({"before": F.lag("end").over(order), "after": F.lead("start").over(order), "mean_width": width})


def neighbours(rows: DataFrame, by: str = "seq_id") -> DataFrame:
    """overlap and gap (both at least 0) to the next interval of the sequence; null for the last."""
    t, after = beside(rows, by), F.col("after")
    return t.withColumns({"overlap": F.when(after.isNotNull(), F.greatest(F.lit(0), F.col("end") - after + 1)), "gap": F.when(after.isNotNull(), F.greatest(F.lit(0), after - F.col("end") - 1))})


def gap_candidates(rows: DataFrame, share: float = 0.5, by: str = "seq_id") -> DataFrame:
    """Gaps whose length is within share of the sequence's mean interval width (rounded half to even)."""
    t = neighbours(rows, by).withColumn("mean_width", F.rint("mean_width"))
    low, high = F.floor(F.col("mean_width") * (1 - share)), F.ceil(F.col("mean_width") * (1 + share))
    return t.where((F.col("gap") >= low) & (F.col("gap") <= high)).select(by, (F.col("end") + 1).alias("start"), (F.col("after") - 1).alias("end"))


def edge_flags(rows: DataFrame, by: str = "seq_id") -> DataFrame:
    """left_edge, right_edge: the first and last interval, and those beside a distance above the mean width."""
    before, after = F.col("start") - F.col("before"), F.col("after") - F.col("end")
    return beside(rows, by).withColumns({"left_edge": F.coalesce(before > F.col("mean_width"), F.lit(True)), "right_edge": F.coalesce(after > F.col("mean_width"), F.lit(True))})


def importance(rows: DataFrame) -> DataFrame:
    """(end - start) * score, or end - start where the score is 0; and the rank within the sequence, first of ties first."""
    value = (F.col("end") - F.col("start")) * F.when(F.col("score") == 0, 1.0).otherwise(F.col("score"))
    order = Window.partitionBy("seq_id").orderBy(F.col("importance").desc(), "start")
    return rows.withColumn("importance", value).withColumn("rank", F.row_number().over(order))


def even_sample(rows: DataFrame, k: int, by: str, order: str) -> DataFrame:
    """k evenly spaced rows of each group (rounded half to even), all rows of a group of at most k."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    t = rows.withColumns({"_n": n, "_i": F.row_number().over(Window.partitionBy(by).orderBy(order))})
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(1 + i * ((F.col("_n") - 1) / (k - 1))).cast("int"))
    return t.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_i"))).drop("_n", "_i")


def smallest_mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.mode(value, True).alias("mode"))


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an explicit order."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_i = 1").drop("_i")

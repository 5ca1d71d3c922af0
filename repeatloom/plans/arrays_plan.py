"""Summaries of arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_and_medians(arrays: DataFrame, repeats: DataFrame, key: str) -> DataFrame:
    """arrays with repeats_number, median_width and median_score (medians rounded up; 0 and -1 without a repeat)."""
    sums = repeats.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile("width", F.lit(0.5)).alias("w"), F.percentile("score", F.lit(0.5)).alias("s"))
    return arrays.join(sums, key, "left").select(
        *arrays.columns, F.coalesce("n", F.lit(0)).cast("long").alias("repeats_number"), F.coalesce(F.ceil("w"), F.lit(0)).cast("long").alias("median_width"), F.coalesce(F.ceil("s"), F.lit(-1)).cast("long").alias("median_score")
    )

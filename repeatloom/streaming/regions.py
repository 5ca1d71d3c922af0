"""Repetitive regions of a stream of sequences: scoring is independent for each sequence, so each micro-batch is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from repeatloom.config import Config
from repeatloom.operators import windows


def write_regions(stream: DataFrame, path: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """stream(seq_id, seq, length) to Parquet under path; a batch that is tried again replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        scores = windows.singleton_score(windows.kmer_totals(df, cfg.window, cfg.k), cfg.k)
        windows.regions(scores, cfg.window, cfg.low_score).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

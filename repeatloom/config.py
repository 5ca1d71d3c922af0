"""Parameters of the repeat pipeline and the schemas of its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    k: int = 10  # of the window score and the distance index
    low_score: float = 90.0  # windows below it are repetitive
    max_repeat: int = 1000
    min_repeat: int = 7
    detach: float = 0.08  # hysteresis of the segmentation
    join: float = 0.04
    max_mismatch: int = 2  # of k-mer clusters
    align_sample: int = 10
    rescore_sample: int = 15
    rescore_least: int = 10
    shift_k: int = 6
    template_gate: float = 0.15
    template_score: float = 0.4
    class_k: int = 7
    class_gate: float = 0.15
    class_distance: float = 0.85
    overlap_drop: float = 0.1
    gap_fill_range: float = 0.5
    gap_fill_score: float = 0.8
    merge_score: float = 30.0
    edge_k: int = 12
    edge_window: float = 1.2
    edge_hits: float = 0.15
    profile_from: int = 14  # periods from here on use the profile mapper
    aligner: Callable[[list[str]], list[str]] | None = None  # in place of the star alignment; see functions/external.py
    mapper: Callable[[str, str], list[tuple]] | None = None  # in place of the built-in profile mapper

    @property
    def window(self) -> int:
        """Tile size of the window score: a tenth more than the longest period and ten."""
        return round((self.max_repeat + 10) * 1.1)



SEQUENCES = "num_id long, seq_id string, seq string, length long"
REGIONS = "starts long, ends long, scores double, seqID string, numID long"
ARRAYS = "start long, end long, seqID string, numID long, score double, top_N long, top_5_N string, representative string"
CLASS_ARRAYS = ARRAYS + ", class string, array_num_ID long"
SUMMARY = CLASS_ARRAYS + ", repeats_number long, median_repeat_width long, median_score long"
REPEATS = "seqID string, arrayID long, start long, end long, strand string, score double, eval double, width long, class string, score_template double"
REPEATS_WITH_SEQUENCE = REPEATS + ", sequence string"


def columns(spec: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in spec.split(",")]

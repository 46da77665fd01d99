"""Tunable parameters of the review pipeline."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults that published results depend on.
MIN_INTERACTIONS = 10
# Share of lines that may be malformed before the run fails.
MAX_MALFORMED = 0.001
ENCODER_BATCH = 1024
ENCODER_DIM = 384
FOREST_TREES = 200
FOREST_SAMPLE = 256
SEED = 42
TEST_RATIO = 0.2
TOP_K = (5, 10, 20)
REPORT_ROWS = 20


@dataclass(frozen=True)
class Config:
    """Inputs, outputs and hyper-parameters of one pipeline run."""

    raw_path: str = "reviews.jsonl"
    out_dir: str = "out"
    min_interactions: int = MIN_INTERACTIONS
    max_malformed: float = MAX_MALFORMED
    encoder_dim: int = ENCODER_DIM
    encoder_batch: int = ENCODER_BATCH
    n_trees: int = FOREST_TREES
    sample_size: int = FOREST_SAMPLE
    seed: int = SEED
    test_ratio: float = TEST_RATIO
    top_k: tuple[int, ...] = TOP_K

    def path(self, name: str) -> str:
        return f"{self.out_dir.rstrip('/')}/{name}"

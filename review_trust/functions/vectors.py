"""Vector helpers used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Scores are compared after rounding, so that ties do not hang on summation order.
SCORE_DIGITS = 9


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, so their cosine is 0."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1.0)

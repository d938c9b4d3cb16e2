"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, text: str | int, size: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in their order, in parts of at most so many bytes of a text column, and so many rows; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(ends.searchsorted(before + size, side="right")))
        to = min(to, at + rows) if rows else to
        yield batch.slice(at, to - at)
        at = to

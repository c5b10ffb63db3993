"""Bounded pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, *text_columns: str, rows: int = 2_000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows and about ``size`` bytes of text; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    used = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), dtype=np.int64) for c in text_columns)
    total = np.cumsum(used)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, min(start + rows, int(np.searchsorted(total, before + size, side="right"))))
        yield batch.slice(start, end - start)
        start = end

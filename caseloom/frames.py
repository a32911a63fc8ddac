"""Rows of a task in runs of bounded bytes, whatever batches the session's settings give.

A batch may hold 10,000 rows or 64 MB. What a worker makes of it, objects and new rows, is made and let go run by run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20
RUN_ROWS = 1000


def runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows of at most ``RUN_BYTES`` and ``RUN_ROWS``, or one larger row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + RUN_BYTES, "right"))
        stop = max(start + 1, min(stop, start + RUN_ROWS))
        yield start, stop
        start = stop


def byte_sizes(columns: list[pa.Array]) -> np.ndarray:
    """Bytes of each row's texts and binaries; other types count nothing."""
    total = np.zeros(len(columns[0]) if columns else 0, np.int64)
    for column in columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def arrow_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in runs(byte_sizes(batch.columns)):
            yield batch.slice(start, stop - start)


def frame_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = np.zeros(len(batch), np.int64)
        for _, column in batch.select_dtypes(object).items():
            sizes += np.fromiter((len(v) if isinstance(v, (str, bytes)) else 0 for v in column), np.int64, len(batch))
        for start, stop in runs(sizes):
            yield batch.iloc[start:stop]

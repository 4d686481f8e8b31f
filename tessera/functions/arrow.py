"""Arrow batches in pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows a Python function holds as objects at a time.
PIECE_ROWS = 512


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, without copying: what Python makes of
    long texts is bounded by these, not by Spark's batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

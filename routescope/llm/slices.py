"""Smaller pieces of Arrow batches, for operators whose working memory is a multiple of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)

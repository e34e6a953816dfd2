"""Running a function over the rows of Arrow batches, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows worked on at once inside a task; texts of more rows are not held in Python together.
ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that their values need not all be in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def mapped(work: Callable[[dict[str, list]], dict[str, object]], schema: pa.Schema):
    """A function for ``mapInArrow``: ``work`` gets lists by column name, returns columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            got = work(part.to_pydict())
            columns = [pa.array(got[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return run

"""Adding columns computed in Python to a DataFrame, batch by batch over Arrow.

A *step* is a zero-argument callable (picklable, made once per task) that gives
a function from a list of texts (or any column's Arrow array) to Arrow arrays.
Rows stay in their partitions: nothing is shuffled, and a lost task is simply
run again. Batches are handed on in slices of bounded size, so that a run of
very long texts does not multiply the worker's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A slice holds about this many bytes of text at most, or one row.
SLICE_BYTES = 4 << 20

#: (input column, output fields, step)
Step = tuple[str, list[T.StructField], Callable[[], Callable[[pa.Array], list[pa.Array]]]]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``limit`` bytes in ``column`` each."""
    n = batch.num_rows
    if n == 0:
        return
    rows = max(1, int(n * limit / max(1, batch.column(column).nbytes)))
    for at in range(0, n, rows):
        yield batch.slice(at, min(rows, n - at))


def with_python_columns(frame: DataFrame, steps: list[Step]) -> DataFrame:
    """``frame`` plus the fields of every step; a field replaces a column of its name.

    A later step may read what an earlier one has made; all run in one pass.
    """
    made = [f for _, fields, _ in steps for f in fields]
    names = {f.name for f in made}
    frame = frame.select(*[c for c in frame.columns if c not in names])
    schema = T.StructType([*frame.schema.fields, *made])
    first = frame.columns.index(steps[0][0])
    plan = [(column, [f.name for f in fields], step) for column, fields, step in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(column, fields, step()) for column, fields, step in plan]
        for batch in batches:
            for part in slices(batch, first):
                arrays = dict(zip(part.schema.names, part.columns, strict=True))
                for column, fields, function in ready:
                    arrays |= zip(fields, function(arrays[column]), strict=True)
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return frame.mapInArrow(run, schema)

"""Arrow batches in and out of Python: small slices, so that a worker holds a bounded number of bytes whatever the texts' lengths."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a worker handles at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch at most: both Spark and the worker hold whole batches besides.
BATCH_ROWS = 1000


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def over_texts(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """df through make()(slice) for each slice of its batches; make runs once per task. The session's batches are made smaller."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, column):
                yield f(part)

    return df.mapInArrow(run, schema)


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the picked pieces of flat; also their lengths."""
    n = lengths[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) - np.repeat(ends - n - starts[pick], n)
    return flat[at], n

"""Arrow batches in Python workers: small steps, and memory given back after them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task
    shall not hold what the last one used."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; freed memory goes back to the system after each."""
    for batch in batches:
        yield batch
        release()


def slices(batches: Iterator[pa.RecordBatch], batch_bytes: float) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``batch_bytes`` each, a row at least; freed
    memory goes back to the system after each batch of Spark's."""
    for batch in batches:
        step = max(1, int(batch.num_rows * batch_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        release()

"""Arrow-batch helpers shared by the operators that run numpy or libraries in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20  # text handled at once inside a task


def text_slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds about ``budget`` bytes of ``column``.

    A single value larger than the budget travels alone; no value is cut.
    """
    for batch in batches:
        sizes = _lengths(batch.column(batch.schema.get_field_index(column)))
        lo, held = 0, 0
        for hi, size in enumerate(sizes):
            if hi > lo and held + size > budget:
                yield batch.slice(lo, hi - lo)
                lo, held = hi, 0
            held += size
        if len(sizes) > lo:
            yield batch.slice(lo, len(sizes) - lo)


def _lengths(col: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        n, scale = pc.list_value_length(col), 4
    else:
        n, scale = pc.binary_length(col), 1
    return [int(x) * scale for x in pc.fill_null(n, 0).to_numpy(zero_copy_only=False)]


def list_array(values: np.ndarray, lengths: Iterable[int], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(1 + len(lengths), dtype=np.int32)
    np.cumsum(np.asarray(lengths, dtype=np.int64), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class BoundedCache(dict):
    """A dictionary that computes missing values and is emptied when it is full."""

    def __init__(self, compute: Callable, limit: int = 1_000_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value

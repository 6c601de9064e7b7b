"""Arrow batches of sorted rows, cut at the ends of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that a task turns into Python objects at a time.
TEXT_BYTES = 1 << 19


def bounded_rows(parts: Iterator[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of batches, in order, with about ``most`` bytes of a text column at a time; a longer text stands alone."""
    for part in parts:
        sizes = np.array(pc.fill_null(pc.binary_length(part.column(column)), 0))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        for begin, end in zip([0, *cuts], [*cuts, part.num_rows]):
            yield part.slice(begin, end - begin)


def whole_groups(parts: Iterator[pa.RecordBatch], keys: list[str], most: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        if part.num_rows == 0:
            continue
        held.append(part)
        rows += part.num_rows
        if rows < most:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        begin = int(group_starts(whole, keys)[-1])
        if begin:
            yield whole.slice(0, begin).combine_chunks()
            whole = whole.slice(begin).combine_chunks()
        held, rows = whole.to_batches(), whole.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(whole: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each group."""
    new = np.zeros(whole.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = whole.column(key)
        values = binary_numbers(values) if pa.types.is_binary(values.type) else values.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def binary_numbers(values: pa.ChunkedArray, kind: str = "<i8") -> np.ndarray:
    """Numbers from binary values of one width, a row each (flat when there is one a row)."""
    return np.frombuffer(b"".join(values.to_pylist()), kind)

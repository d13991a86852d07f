"""Groups of sorted rows, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _column(column: pa.Array, width: int) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.dtype(f"V{width}"))
    return column.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16, width: int = 32) -> Iterator[list[np.ndarray]]:
    """The columns of batches whose rows are sorted by the first `keys` columns, in pieces of some
    `rows` rows, or of one group if that is larger: no group is in two pieces. Binary columns
    hold `width` bytes a row."""
    held: list[np.ndarray] | None = None
    enough = rows
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [_column(c, width) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]) < enough:
            continue
        starts = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in held[:keys]]))
        last = int(np.flatnonzero(starts)[-1])  # this group may go on
        if last:
            yield [x[:last] for x in held]
            held = [x[last:] for x in held]
        enough = max(rows, 2 * len(held[0]))
    if held is not None and len(held[0]):
        yield held

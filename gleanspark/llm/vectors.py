"""What the vector operators share: which vectors count, reading them from Arrow, and runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for a vector that is not null, not empty, not zero, and free of null, NaN and infinite components."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as a matrix in double precision, each scaled by a power of two so that no square overflows or vanishes.

    Such a factor changes no digit, so cosines are those of the vectors as given.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    _, exponent = np.frexp(np.abs(rows).max(1, initial=0.0, keepdims=True))
    far = np.abs(exponent) > 256  # others stay far from either end when squared and summed
    return np.ldexp(rows, np.where(far, -exponent, 0)) if far.any() else rows


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys in sorted batches; a run that spans batches comes whole."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        change = np.zeros(part.num_rows, bool)
        for k in keys:
            values = part.column(k).combine_chunks()
            values = values.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        first = tuple(part.column(k)[0].as_py() for k in keys)
        if last is not None and first != last:
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), part.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
        last = tuple(part.column(k)[part.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.concat_tables(held)


def pieces(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for each stretch of equal keys within a batch of sorted ones; a run that spans batches comes in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(batch.column(k)[a].as_py() for k in keys), batch.slice(a, b - a)

"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: The white space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of `text` each."""
    column = batch.column(batch.schema.get_field_index(text))
    if len(batch) == 0:
        return
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    part = np.cumsum(lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def starts(lengths: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs begins, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges first[i] .. first[i] + lengths[i] - 1."""
    lengths = np.asarray(lengths, np.int64)
    at = starts(lengths)
    return np.repeat(np.asarray(first, np.int64) - at[:-1], lengths) + np.arange(at[-1])


def grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[list[tuple]]:
    """Consecutive rows with equal first `keys` columns, cut after `most` rows."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[:keys] != held[0][:keys] or len(held) == most):
                yield held
                held = []
            held.append(row)
    if held:
        yield held

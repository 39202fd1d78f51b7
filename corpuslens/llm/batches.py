"""Helpers inside tasks: chunks of text as numbers, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are taken together until they have so many characters; a longer text is taken alone.
BATCH_CHARS = 8_000_000


class Kept(dict):
    """Values by key, made when first asked for; of rarely asked ones old generations are dropped."""

    def __init__(self, make, size: int = 300_000) -> None:
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def chunks_of(text: str) -> list[str]:
    """What stands between white space."""
    return text.split()


def numbered(texts: list[str], kept: Kept) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all chunks of all texts, and where each text starts (one more at the end)."""
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        chunks = chunks_of(text)
        parts.append(np.fromiter(map(kept.__getitem__, chunks), np.int64, len(chunks)))
        starts[i + 1] = starts[i] + len(chunks)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), starts


def slices(batch: pa.RecordBatch, column: str, chars: int = BATCH_CHARS,
           ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts (null: empty), each of about ``chars``."""
    texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start:i + 1]
            start, held = i + 1, 0


def rows_of(starts: np.ndarray) -> np.ndarray:
    """The row of each element, from where the rows start."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums by row; values may have a second dimension."""
    if values.ndim == 1:
        return np.bincount(rows, values, n)
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1)

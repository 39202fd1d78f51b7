"""Edit distance with adjacent transpositions (optimal string alignment)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _code_points(values: pd.Series, width: int, pad: int) -> np.ndarray:
    out = np.full((len(values), width), pad, dtype=np.int32)
    lengths = values.str.len().to_numpy()
    out[np.arange(width) < lengths[:, None]] = np.frombuffer(
        "".join(values).encode("utf-32-le"), np.int32)
    return out


def osa_distances(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Distances of a whole batch of pairs: each step of the table is one numpy operation."""
    n, m = left.str.len().to_numpy(), right.str.len().to_numpy()
    if len(left) == 0:
        return np.zeros(0, dtype=np.int32)
    rows, cols = int(n.max()), int(m.max())
    a, b = _code_points(left, rows, -1), _code_points(right, cols, -2)
    table = np.zeros((rows + 1, cols + 1, len(left)), dtype=np.int32)
    table[:, 0] = np.arange(rows + 1)[:, None]
    table[0, :] = np.arange(cols + 1)[:, None]
    for i in range(1, rows + 1):
        for j in range(1, cols + 1):
            same = a[:, i - 1] == b[:, j - 1]
            best = np.minimum(table[i - 1, j], table[i, j - 1]) + 1
            best = np.minimum(best, table[i - 1, j - 1] + ~same)
            if i > 1 and j > 1:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swapped, np.minimum(best, table[i - 2, j - 2] + 1), best)
            table[i, j] = best
    return table[n, m, np.arange(len(left))]


@F.pandas_udf(T.IntegerType())
def osa_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Distance of each pair; pairs of long strings are worked in smaller steps."""
    out = np.zeros(len(left), dtype=np.int32)
    size = np.maximum(left.str.len(), right.str.len()).to_numpy()
    for low, high in ((0, 16), (17, 64), (65, 10 ** 9)):
        chosen = np.flatnonzero((size >= low) & (size <= high))
        step = max(1, 4_000_000 // (min(high, 256) + 1) ** 2)
        for at in range(0, len(chosen), step):
            part = chosen[at:at + step]
            out[part] = osa_distances(left.iloc[part], right.iloc[part])
    return pd.Series(out)

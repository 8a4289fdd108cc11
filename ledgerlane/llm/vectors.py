"""What the vector operators share: valid rows, bounded samples, arrays from columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and numbers that a sample may hold on the driver.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4 << 20


def usable(vector: str = "embedding") -> Column:
    """Not null, not zero, every component finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows in double precision; shorter vectors are padded with zeros."""
    rows = vectors.to_list()
    if not rows:
        return np.zeros((0, width))
    if all(len(r) == width for r in rows):
        return np.array(rows, dtype=np.float64)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def sample(rows: DataFrame, key: str, width: int, of: int | None = None) -> np.ndarray:
    """A bounded sample, the same on every run: the rows of the smallest hashes of key. If the number
    of rows is given, those far from the smallest stay where they are, so that about twice the sample
    is gathered, whatever the number of partitions."""
    n = max(256, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(width, 1)))
    if of and of > 2 * n:
        rows = rows.filter(F.xxhash64(key) < F.lit(int(-(2**63) + 2.0**64 * 2 * n / of)))
    got = rows.orderBy(F.xxhash64(key), key).limit(n).select("embedding").toArrow()
    return matrix(pd.Series(got["embedding"].to_pylist(), dtype=object), width)

"""Bitmaps of fixed size gathered from segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Bytes of a bitmap that the driver takes in one job.
AT_ONCE = 8 << 20


def collect_bitmap(segments: DataFrame, count: int, size: int) -> np.ndarray:
    """Rows (segment, bits of ``size`` bytes) as one array of ``count * size`` bytes.
    The caller bounds ``count``; a segment without a row is zero."""
    found = np.zeros(count * size, np.uint8)
    # A local iterator runs a job for each partition, mostly empty ones, so it is left to
    # bitmaps that the JVM should not hold whole beside this array.
    rows = segments.collect() if count * size <= AT_ONCE else segments.toLocalIterator()
    for segment, bits in rows:
        found[segment * size : (segment + 1) * size] = np.frombuffer(bits, np.uint8)
    return found

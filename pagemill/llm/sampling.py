"""Bounded samples for fitting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``keys`` (equal hashes by the keys), in that order.

    Rows are counted first, so that each task passes on only those under the hash that ``most`` rows are expected to lie under (with six deviations to spare), instead of ``most`` rows a task.
    """
    n = rows.count()
    h = F.xxhash64(*keys)
    if n > most:
        share = (most + 6 * math.sqrt(most) + 6) / n
        if share < 1:
            rows = rows.where(h < F.lit(int((share - 0.5) * 2.0**64)))
    return rows.orderBy(h, *keys).limit(most)

"""A bounded sample to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELLS = 1 << 30


def bounded(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows and never more, chosen by hash of the key; all of fewer rows.

    Each task drops what is not wanted, so no more than about ``most`` rows meet in one
    place however many there are.
    """
    total = rows.count()
    if total > most:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(_CELLS)) < int(_CELLS * most / total))
    return rows.orderBy(F.xxhash64(key), key).limit(most)

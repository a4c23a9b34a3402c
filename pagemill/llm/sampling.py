"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLOTS = 1 << 30


def sample(table: DataFrame, chosen: DataFrame, n: int, *columns: str) -> DataFrame:
    """About ``n`` rows of ``chosen``, never over 2 n, those whose hash is low for the table's size.

    ``chosen`` is the table behind a filter and a projection. Every task keeps only its share
    of the n rows, so nothing grows with the table; small tables are taken whole.
    """
    share = min(1.0, n / max(1, table.count()))
    return chosen.where(F.pmod(F.xxhash64(*columns), F.lit(_SLOTS)) < int(share * _SLOTS)).limit(2 * n)

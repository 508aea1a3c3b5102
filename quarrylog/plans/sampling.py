"""Bounded samples that do not depend on partitions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_by_hash(df: DataFrame, h: Column, ties: list[str], k: int, n: int) -> DataFrame:
    """The ``k`` rows of ``df`` (of some ``n``) with the least 64-bit hash ``h``, ties by columns.

    Rows above a bound that leaves somewhat more than k of them go before the ordering, so that no task gets k rows from
    every partition. Should the bound leave too few, all rows are ordered.
    """
    share = (k + 8 * sqrt(k) + 64) / max(1, n)
    if share < 1:
        some = df.where(h < int(-(2**63) + share * 2**64))
        if some.count() >= k:
            df = some
    return df.orderBy(h, *ties).limit(k)

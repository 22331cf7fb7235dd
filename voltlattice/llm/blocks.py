"""Cutting rows into blocks along an ascending key, so that each is a task and none is all of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from voltlattice.llm.common import partitions


class Blocks:
    """Blocks 0 ... count - 1 in ascending order of a numeric key; null keys are in block 0.

    The bounds are approximate quantiles of the key: at most one for each shuffle partition, so the
    only thing that reaches the driver has the size of a session setting. The bounds are searched
    in two levels, so that a row costs about two square roots of their number.
    """

    def __init__(self, df: DataFrame, key: str, count: int | None = None):
        count = count or partitions(df.sparkSession)
        shares = [k / count for k in range(1, count)]
        found = df.agg(F.percentile_approx(key, shares, 100 * count)).first()[0] if shares else None
        bounds = sorted(set(found or []))
        self.count = len(bounds) + 1
        width = max(1, math.isqrt(len(bounds)))
        self._groups = [bounds[k:k + width] for k in range(0, len(bounds), width)]
        self._key = key

    def column(self, key: str | None = None) -> Column:
        """The number of bounds up to the key."""
        k = F.col(key or self._key)
        if not self._groups:
            return F.lit(0)
        firsts = F.array(*(F.lit(g[0]) for g in self._groups))
        fine = F.array(*(F.array(*(F.lit(b) for b in g)) for g in self._groups))
        group = F.size(F.filter(firsts, lambda b: b <= k))
        within = F.size(F.filter(F.element_at(fine, F.greatest(group, F.lit(1))), lambda b: b <= k))
        return F.when(k.isNull() | (group == 0), 0).otherwise((group - 1) * len(self._groups[0]) + within).cast("int")

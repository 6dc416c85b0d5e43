"""Random values that a seed and a row's key fix, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number from low up to, not including, high."""
    unit = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)
    return low + unit * (high - low)


def choice(seed: int, values: Column, *key: Column) -> Column:
    """An element of an array, each as likely."""
    return F.get(values, F.floor(uniform(seed, *key) * F.size(values)).cast("int"))


def weighted_choice(seed: int, weights: dict[str, float], *key: Column) -> Column:
    """A name, in proportion to its weight."""
    total, u = sum(weights.values()), uniform(seed, *key)
    out, below = None, 0.0
    for name, w in weights.items():
        below += w / total
        out = F.when(u < below, name) if out is None else out.when(u < below, name)
    return out.otherwise(list(weights)[-1])


def draws(seed: int, n: int, *key: Column) -> Column:
    """n numbers from 0 up to 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pmod(F.xxhash64(F.lit(seed), i, *key), F.lit(1 << 53)) / float(1 << 53))


def unique_choice(seed: int, values: Column, n: int, *key: Column) -> Column:
    """n different places' elements of an array, in random order."""
    keyed = F.transform(values, lambda v, i: F.struct(F.xxhash64(F.lit(seed), i, *key).alias("h"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda e: e["v"])


def seed_of(*key: Sequence[Column]) -> Column:
    """A seed for each row, derived from its key."""
    return F.xxhash64(*key)

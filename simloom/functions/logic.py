"""Logic and comparison on Columns; a comparison with a null operand is false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import to_bool, type_name


def all_of(*pairs: tuple[Column, str]) -> Column:
    """The last value if all are true, else null. Operands are (column, type) of one type."""
    truth = reduce(lambda a, b: a & b, (to_bool(x, k) for x, k in pairs))
    return F.when(truth, pairs[-1][0])


def any_of(*pairs: tuple[Column, str]) -> Column:
    """The first true value, else null."""
    return F.coalesce(*(F.when(to_bool(x, k), x) for x, k in pairs))


def odd_of(*pairs: tuple[Column, str]) -> Column:
    """Whether an odd number of operands is true."""
    return sum((to_bool(x, k).cast("int") for x, k in pairs), F.lit(0)) % 2 == 1


def negation(x: Column, kind: str) -> Column:
    return ~to_bool(x, kind)


def equal(*xs: Column) -> Column:
    """All equal; null equals null."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(xs[0]) for x in xs[1:]), F.lit(True))


def unequal(*xs: Column) -> Column:
    """No two equal."""
    return reduce(lambda a, b: a & b, (~xs[i].eqNullSafe(xs[j]) for i in range(len(xs)) for j in range(i)), F.lit(True))


def _chain(compare, xs: tuple[Column, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, (compare(a, b) for a, b in zip(xs, xs[1:], strict=False)), F.lit(True)), F.lit(False))


def less(*xs: Column) -> Column:
    return _chain(lambda a, b: a < b, xs)


def less_equal(*xs: Column) -> Column:
    return _chain(lambda a, b: a <= b, xs)


def greater(*xs: Column) -> Column:
    return _chain(lambda a, b: a > b, xs)


def greater_equal(*xs: Column) -> Column:
    return _chain(lambda a, b: a >= b, xs)


def same_type(*kinds: str) -> Column:
    return F.lit(len({type_name(k) for k in kinds}) == 1)


def no_same_type(*kinds: str) -> Column:
    return F.lit(len({type_name(k) for k in kinds}) == len(kinds))


def choose(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first branch whose condition holds."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise) if otherwise is not None else out

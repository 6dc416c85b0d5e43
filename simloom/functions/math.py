"""Scalar and array mathematics on Columns. Domain errors give null, division by zero gives an infinity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import clean

INF = float("inf")


def add(*xs: Column) -> Column:
    return clean(reduce(lambda a, b: a + b, (x.cast("double") for x in xs), F.lit(0.0)))


def subtract(x: Column, *more: Column) -> Column:
    return clean(reduce(lambda a, b: a - b.cast("double"), more, x.cast("double"))) if more else clean(-x.cast("double"))


def multiply(*xs: Column) -> Column:
    return clean(reduce(lambda a, b: a * b, (x.cast("double") for x in xs), F.lit(1.0)))


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).when((a != 0) & (b == 0), F.when(a > 0, INF).otherwise(-INF))


def divide(x: Column, *more: Column) -> Column:
    """Left to right; a single operand gives its reciprocal. x/0 is an infinity, 0/0 null."""
    if not more:
        return _over(F.lit(1.0), clean(x))
    return reduce(lambda a, b: _over(a, clean(b)), more, clean(x))


def mod(x: Column, *more: Column) -> Column:
    """Remainder with the sign of the dividend; null for a zero divisor."""
    return reduce(lambda a, b: F.try_mod(a, clean(b)), more, clean(x)) + 0.0  # no negative zero


def floor(x: Column) -> Column:
    return F.floor(clean(x)).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(clean(x)).cast("double")


def round_to(x: Column, significant: int | None = None, decimals: int | None = None) -> Column:
    """Nearest whole number, halves away from zero; or so many significant digits, with at least so many decimals."""
    d = clean(x)
    if significant is None:
        return F.signum(d) * F.floor(F.abs(d) + 0.5).cast("double")
    power = F.lit(float(significant - 1)) - F.floor(F.log10(F.abs(d))).cast("double")
    if decimals is not None:
        power = F.least(power, F.lit(float(decimals)))
    scale = F.pow(F.lit(10.0), F.abs(power))
    near = F.when(power >= 0, F.floor(F.abs(d) * scale + 0.5) / scale).otherwise(F.floor(F.abs(d) / scale + 0.5) * scale)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.signum(d) * near)


def maximum(*xs: Column) -> Column:
    return F.greatest(*(clean(x) for x in xs)) if len(xs) > 1 else clean(xs[0])


def minimum(*xs: Column) -> Column:
    return F.least(*(clean(x) for x in xs)) if len(xs) > 1 else clean(xs[0])


def index_of_max(values: Column) -> Column:
    """All places (from 0) of the largest element."""
    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, i) == F.array_max(values))


def index_of_min(values: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, i) == F.array_min(values))


def keys_of_max(values: Column) -> Column:
    return F.map_keys(F.map_filter(values, lambda _, v: v == F.array_max(F.map_values(values))))


def keys_of_min(values: Column) -> Column:
    return F.map_keys(F.map_filter(values, lambda _, v: v == F.array_min(F.map_values(values))))


def get_digits(x: Column, base: int, first: int, last: int) -> Column:
    """Digits at powers first (high) down to last (low) of the base."""
    return F.transform(
        F.array(*(F.lit(p) for p in range(first, last - 1, -1))),
        lambda p: F.floor(F.abs(clean(x)) / F.pow(F.lit(float(base)), p)).cast("double") % F.lit(float(base)),
    )


def set_digits(x: Column, base: int, digits: Sequence[int | None], first: int) -> Column:
    """x with the digits from power `first` downwards replaced; None keeps a digit."""
    out = clean(x)
    for k, digit in enumerate(digits):
        if digit is not None:
            unit = F.lit(float(base) ** (first - k))
            old = F.floor(F.abs(clean(x)) / unit) % F.lit(float(base))
            out = out + F.when(clean(x) < 0, -1.0).otherwise(1.0) * (F.lit(float(digit)) - old) * unit
    return out


def exp(x: Column) -> Column:
    return F.exp(clean(x))


def log(x: Column, base: float | None = None) -> Column:
    d = clean(x)
    out = F.when(d > 0, F.log(d)).when(d == 0, F.lit(-INF))
    return out / F.lit(math.log(base)) if base is not None else out


def sqrt(x: Column) -> Column:
    return clean(F.sqrt(clean(x)))


def power(x: Column, y: Column) -> Column:
    return clean(F.pow(clean(x), clean(y)))


def _vectorised(f):
    def safe(v: float) -> float | None:
        try:
            return f(v)
        except (ValueError, OverflowError):
            return INF if v is not None and v > 0 else None

    @F.pandas_udf("double")
    def over(values: pd.Series) -> pd.Series:
        return values.map(safe, na_action="ignore")

    return over


def erf(x: Column) -> Column:
    """Error function; Spark has none, so values go over in Arrow batches."""
    return _vectorised(math.erf)(clean(x))


def gamma(x: Column) -> Column:
    return _vectorised(math.gamma)(clean(x))


def lgamma(x: Column) -> Column:
    return _vectorised(math.lgamma)(clean(x))


def dot(x: Column, y: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def dot_maps(x: Column, y: Column) -> Column:
    """Sum of products of two maps, matched by key."""
    both = F.map_values(F.map_zip_with(x, y, lambda _, a, b: a.cast("double") * b.cast("double")))
    return F.aggregate(both, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def norm(values: Column, p: float = 1.0) -> Column:
    size = F.transform(values, lambda e: F.abs(e.cast("double")))
    if p == INF:
        return F.array_max(size)
    if p == 1:
        return F.aggregate(size, F.lit(0.0), lambda acc, e: acc + e)
    if p == 2:
        return F.sqrt(F.aggregate(size, F.lit(0.0), lambda acc, e: acc + e * e))
    return F.pow(F.aggregate(size, F.lit(0.0), lambda acc, e: acc + F.pow(e, F.lit(float(p)))), F.lit(1.0 / p))


def normalize(values: Column, p: float = 1.0) -> Column:
    """Divides by the Lp norm; equal shares if that is 0."""
    total = norm(values, p)
    return F.transform(values, lambda e: F.when(total != 0, e.cast("double") / total).otherwise(F.lit(1.0) / F.size(values)))


def entropy(p: Column, q: Column | None = None, p_exponent: float = 1.0, q_exponent: float = 0.0) -> Column:
    """-sum p ln(p^a q^b): entropy by default; cross entropy with a = 0, b = 1; KL divergence with a = -1, b = 1, negated sign included."""
    if q is None:
        terms = F.transform(p, lambda a: F.when(a > 0, a * p_exponent * F.log(a)).otherwise(0.0))
    else:
        terms = F.zip_with(
            p, q, lambda a, b: F.when(a > 0, a * (F.lit(p_exponent) * F.log(a) + F.when(b > 0, q_exponent * F.log(b)).otherwise(-INF * q_exponent if q_exponent else 0.0))).otherwise(0.0)
        )
    return -F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


# Trigonometry: values outside of a function's domain give null.


def _plain(f):
    return lambda x: clean(f(clean(x)))


sin, cos, tan = _plain(F.sin), _plain(F.cos), _plain(F.tan)
asin, acos = _plain(F.asin), _plain(F.acos)
sinh, cosh, tanh = _plain(F.sinh), _plain(F.cosh), _plain(F.tanh)
asinh, acosh, atanh = _plain(F.asinh), _plain(F.acosh), _plain(F.atanh)


def atan(x: Column, y: Column | None = None) -> Column:
    return F.atan(clean(x)) if y is None else F.atan2(clean(x), clean(y))


# Statistics over arrays.


def array_mode(values: Column, weights: Column | None = None) -> Column:
    """Element of the largest count or weight; the smallest of those that tie."""
    seen = F.array_sort(F.array_distinct(values))
    pairs = F.arrays_zip(values.alias("v"), (weights if weights is not None else F.transform(values, lambda _: F.lit(1.0))).alias("w"))
    mass = F.transform(
        seen, lambda s: F.struct(F.aggregate(F.filter(pairs, lambda e: e["v"] == s), F.lit(0.0), lambda acc, e: acc + e["w"].cast("double")).alias("m"), s.alias("v"))
    )
    top = F.array_max(F.transform(mass, lambda m: m["m"]))
    return F.get(F.filter(mass, lambda m: m["m"] == top), F.lit(0))["v"]


def array_quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array's numbers."""
    if not 0 <= q <= 1:
        return F.lit(None).cast("double")
    own = F.array_sort(F.filter(F.transform(values, clean), lambda e: e.isNotNull()))
    at = F.lit(float(q)) * (F.size(own) - 1)
    low, high = F.get(own, F.floor(at).cast("int")), F.get(own, F.ceil(at).cast("int"))
    return F.when(F.size(own) > 0, low + (high - low) * (at - F.floor(at)))


def array_generalized_mean(values: Column, p: float = 1.0, center: float = 0.0, moment: bool = False, absolute: bool = False) -> Column:
    """Power mean of an array's numbers about a center; with moment, without the final root."""
    own = F.transform(F.filter(F.transform(values, clean), lambda e: e.isNotNull()), lambda e: F.abs(e - center) if absolute else e - center)
    n = F.size(own)
    if p == 0:
        total = F.aggregate(F.transform(own, lambda e: F.when(e > 0, F.log(e)).when(e == 0, -INF)), F.lit(0.0), lambda acc, e: acc + e)
        return F.when(n > 0, F.exp(total if moment else total / n))
    total = F.aggregate(F.transform(own, lambda e: F.pow(e, F.lit(float(p)))), F.lit(0.0), lambda acc, e: acc + e)
    return F.when(n > 0, clean(total / n if moment else F.pow(total / n, F.lit(1.0 / p))))

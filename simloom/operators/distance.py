"""Mixed-type generalized distance and surprisal as one Column: a term a feature, so Catalyst prunes and compiles it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import edit_distance

INF = float("inf")


@dataclass
class Feature:
    """How one column takes part in a distance.

    kind: continuous, cyclic, nominal, or string (insertions and deletions between texts). deviation: expected noise of
    the column, 0 for none. cycle: length of a cyclic column's period. classes: number of classes of a nominal one.
    known_unknown and unknown_unknown: difference if one or both values are null; a missing one is the other, both
    missing `most`, the largest difference of the column. confusion: nominal deviations by (own, other) value.
    ``fitted`` takes classes and most from the data.
    """

    name: str
    kind: str = "continuous"
    weight: float | None = None
    deviation: float = 0.0
    cycle: float | None = None
    classes: float | None = None
    known_unknown: float | None = None
    unknown_unknown: float | None = None
    most: float | None = None
    confusion: dict[tuple, float] = field(default_factory=dict)


def fitted(df: DataFrame, features: Sequence[Feature], surprisal: bool = False, point: Sequence | None = None) -> list[Feature]:
    """The features with the statistics that the data tells where none are given: one aggregation over df, none without need.
    The rows of df have no nulls in the features; a point may.

    A nominal column has as many classes as distinct values, and 1 / (values + 0.5) more for those not seen yet; they
    count where values may be mistaken. The largest difference, which counts where nulls do, is the span of a continuous
    column, half a cycle, twice the longest text, or just below 1 for a nominal one.
    """
    wanted = {}
    for i, f in enumerate(features):
        c = F.col(f.name)
        if f.kind == "nominal" and f.classes is None and (surprisal or f.deviation > 0):
            wanted[f"classes_{i}"] = F.count_distinct(c) + 1 / (F.count(c) + 0.5)
        if f.most is None and f.known_unknown is None and f.unknown_unknown is None and point is not None and point[i] is None:
            if f.kind == "continuous":
                wanted[f"most_{i}"] = F.coalesce(F.max(c.cast("double")) - F.min(c.cast("double")), F.lit(0.0))
            elif f.kind == "string":
                wanted[f"most_{i}"] = F.coalesce(2.0 * F.max(F.char_length(c.cast("string"))), F.lit(0.0))
            elif f.kind == "nominal":
                wanted[f"most_{i}"] = 1 - 1 / (F.greatest(F.count(c), F.lit(1)) + 0.5)
    known = df.agg(*(v.alias(k) for k, v in wanted.items())).first().asDict() if wanted else {}
    out = []
    for i, f in enumerate(features):
        most = f.cycle / 2 if f.kind == "cyclic" and f.most is None and f.cycle else known.get(f"most_{i}", f.most)
        out.append(replace(f, classes=known.get(f"classes_{i}", f.classes), most=most))
    return out


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def difference_term(f: Feature, a: Column, b: Column, surprisal: bool) -> tuple[Column, Column | None]:
    """The feature's difference, and the difference of equal nominal values with a deviation, or None."""
    match = None
    if f.kind == "nominal":
        s, n = f.deviation, f.classes or 2.0
        if surprisal:
            s = s or 1e-9
            term = F.when(_same(a, b), 0.0).otherwise(math.log(1 - s) - math.log(s / max(n - 1, 1e-9)))
            for (x, y), d in f.confusion.items():
                own = f.confusion.get((x, x), s)
                term = F.when((a == F.lit(x)) & (b == F.lit(y)), math.log(max(1 - own, 1e-12)) - math.log(max(1 - d, 1e-12)) if x != y else 0.0).otherwise(term)
        elif s > 0:
            term, match = F.lit(1 - s / max(n - 1, 1)), F.lit(s)
        else:
            term = F.when(_same(a, b), 0.0).otherwise(1.0)
    else:
        d = edit_distance(a, b) if f.kind == "string" else F.abs(a.cast("double") - b.cast("double"))
        if f.kind == "cyclic":
            d = F.least(d % f.cycle, f.cycle - d % f.cycle)
        s = f.deviation
        if s > 0:
            term = d + 0.5 * F.exp(-d / s) * (3 * s + d)
            if surprisal:
                term = F.when(d == 0, 0.0).otherwise(F.greatest(term / s - 1.5, F.lit(0.0)))
        else:
            term = d
    one = f.known_unknown if f.known_unknown is not None else f.unknown_unknown if f.unknown_unknown is not None else INF if f.most is None else f.most
    both = f.unknown_unknown if f.unknown_unknown is not None else f.known_unknown if f.known_unknown is not None else INF if f.most is None else f.most
    term = F.when(a.isNull() & b.isNull(), F.lit(float(both))).when(a.isNull() | b.isNull(), F.lit(float(one))).otherwise(term)
    return term, match


def generalized_distance(features: Sequence[Feature], left: Sequence[Column], right: Sequence[Column], p: float = 1.0, surprisal: bool = False) -> Column:
    """(sum of w * D^p)^(1/p) over the features; p 0: product of D^w; p infinite: the largest, or smallest, D.

    Features of weight 0 are left out. Weights that are not given are 1, or in surprisal space one divided by the
    number of features.
    """
    default = 1.0 / max(1, len(features)) if surprisal else 1.0
    terms = []
    for f, a, b in zip(features, left, right, strict=True):
        w = default if f.weight is None else f.weight
        if w == 0:
            continue
        term, match = difference_term(f, a, b, surprisal)
        if p == 0:
            made = F.pow(term, F.lit(w))
            again = None if match is None else F.pow(F.pow(match, F.lit(w)), F.lit(w))
        elif math.isinf(p):
            made, again = term, match
        else:
            made = F.lit(w) * (term if p == 1 else F.pow(term, F.lit(float(p))))
            # For equal nominal values that have a deviation, weight and power apply twice.
            again = None if match is None else F.lit(w) * F.pow(F.lit(w) * F.pow(match, F.lit(float(p))), F.lit(float(p)))
        terms.append(made if again is None else F.when(_same(a, b), again).otherwise(made))
    if not terms:
        return F.lit(0.0)
    if p == 0:
        return reduce(lambda x, y: x * y, terms)
    if math.isinf(p):
        return (F.greatest if p > 0 else F.least)(*terms) if len(terms) > 1 else terms[0]
    total = reduce(lambda x, y: x + y, terms)
    return total if p == 1 else F.sqrt(total) if p == 2 else F.pow(total, F.lit(1.0 / p))


def transform(distance: Column, exponent: float | str = 1.0, weight: Column | None = None) -> Column:
    """A distance as it is reported: raw above 0, d^e times the weight below, the weight itself at 0; `surprisal` keeps
    the distance, `surprisal_to_prob` gives e^-d times the weight."""
    if exponent == "surprisal_to_prob":
        out = F.exp(-distance)
        return out * weight if weight is not None else out
    if exponent == "surprisal" or exponent > 0:
        return distance
    if exponent == 0:
        return weight if weight is not None else F.lit(1.0)
    if weight is None and exponent != -1:
        return distance
    out = F.when(distance == 0, INF).otherwise(F.pow(distance, F.lit(float(exponent))))
    return out * weight if weight is not None else out

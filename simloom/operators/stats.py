"""Weighted statistics of one column. Rows without a weight count as weight 1; null values are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clean
from ..plans.running import neighbour_gaps, with_running_sum

INF = float("inf")


def _weight(weight: str | None) -> Column:
    return F.coalesce(clean(F.col(weight)), F.lit(1.0)) if weight else F.lit(1.0)


def _valued(df: DataFrame, value: str, weight: str | None) -> DataFrame:
    return df.select(clean(F.col(value)).alias("v"), _weight(weight).alias("w")).filter("v is not null")


def weighted_sum(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(sum): of weight times value; rows of weight 0 are skipped, so infinities there don't matter. 0 without rows."""
    rows = _valued(df, value, weight)
    return rows.agg(F.coalesce(F.sum(F.when(F.col("w") != 0, F.col("w") * F.col("v"))), F.lit(0.0)).alias("sum"))


def value_masses(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, mass): number or total weight of the rows of each value."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.sum(_weight(weight)).alias("mass"))


def mode(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(mode): value of the largest mass above 0; of those that tie, the smallest."""
    masses = value_masses(df, value, weight).filter("mass > 0")
    return masses.agg(F.min_by("value", F.struct(-F.col("mass"), F.col("value"))).alias("mode"))


def quantile(df: DataFrame, value: str, q: float, weight: str | None = None) -> DataFrame:
    """(quantile): linearly interpolated. With equal weights the usual definition; else the cumulative share of a row
    is that of the weight before it and half its own, and values beyond the first and last are clamped.

    Values are aggregated first, then summed up over range buckets, so neither a frequent value nor the whole table
    meets in one task.
    """
    spark = df.sparkSession
    if not 0 <= q <= 1:
        return spark.range(1).select(F.lit(None).cast("double").alias("quantile"))
    rows = _valued(df, value, weight).filter("w <> 0")
    if q in (0, 1):
        return rows.agg((F.min("v") if q == 0 else F.max("v")).alias("quantile"))
    own = rows.groupBy("v").agg(F.sum("w").alias("s"), F.min("w").alias("first"), F.max("w").alias("last"))
    points = with_running_sum(own, "v", "s", "before").select(
        "v", (F.col("before") + F.col("first") / 2).alias("c1"), (F.col("before") + F.col("s") - F.col("last") / 2).alias("c2")
    )
    whole = own.agg(F.sum("s").alias("W"), F.min("first").alias("lo"), F.max("last").alias("hi"))
    target = F.when(F.col("lo") == F.col("hi"), F.lit(q) * (F.col("W") - F.col("lo")) + F.col("lo") / 2).otherwise(F.lit(q) * F.col("W"))
    at = points.crossJoin(F.broadcast(whole.select(target.alias("t"))))  # one row
    below, above = F.col("c1") <= F.col("t"), F.col("c2") >= F.col("t")
    side = at.agg(
        F.max_by(F.struct("v", "c2"), F.when(below, F.col("c1"))).alias("x"),
        F.min_by(F.struct("v", "c1"), F.when(above, F.col("c2"))).alias("y"),
        F.max("t").alias("t"),
    )
    x, y = F.col("x"), F.col("y")
    share = (F.col("t") - x["c2"]) / F.nullif(y["c1"] - x["c2"], F.lit(0.0))
    return side.select(
        F.when(x.isNull(), y["v"]).when(y.isNull(), x["v"]).when(x["v"] == y["v"], x["v"]).otherwise(x["v"] + (y["v"] - x["v"]) * share).alias("quantile")
    )


def generalized_mean(
    df: DataFrame, value: str, p: float = 1.0, weight: str | None = None, center: float = 0.0, moment: bool = False, absolute: bool = False
) -> DataFrame:
    """(mean): power mean about a center: p 1 arithmetic, 2 root mean square, 0 geometric, -1 harmonic.

    With moment the root is left out. Null without rows and where a base is negative and the power isn't whole; the
    geometric mean is 0 if any value is, null if any is negative.
    """
    rows = _valued(df, value, weight).filter("w <> 0")
    diff = F.col("v") - F.lit(float(center))
    diff = F.abs(diff) if absolute else diff
    total, w = F.sum("w"), F.col("w")
    if p == 0:
        logs = F.sum(w * F.when(diff > 0, F.log(diff)))
        inner = logs if moment and weight is None else logs / total
        made = inner if moment and weight is not None else F.exp(inner)
        mean = F.when(F.min(diff) < 0, None).when(F.min(diff) == 0, F.lit(0.0)).otherwise(made)
    else:
        term = diff if p == 1 else diff * diff if p == 2 else F.when(diff != 0, 1.0 / diff).otherwise(INF) if p == -1 else F.pow(diff, F.lit(float(p)))
        mean = F.sum(w * term) / total
        if not moment and p != 1:
            mean = F.sqrt(mean) if p == 2 else F.when(mean != 0, 1.0 / mean).otherwise(INF) if p == -1 else F.pow(mean, F.lit(1.0 / p))
    return rows.agg(clean(mean).alias("mean"))


def _difference(df: DataFrame, value: str, cycle: float | None, largest: bool, zero: bool) -> DataFrame:
    counted = _valued(df, value, None).groupBy("v").agg(F.count("*").alias("n"))
    gaps = neighbour_gaps(counted, "v")
    ends = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"), F.max("n").alias("most"))
    best = gaps.agg((F.max if largest else F.min)("gap").alias("gap"))
    both = ends.crossJoin(best)  # a row each
    gap = F.when(F.col("most") > 1, F.lit(0.0)) if zero else F.lit(None).cast("double")
    pick = F.greatest if largest else F.least
    wrap = F.lit(None).cast("double") if cycle is None else F.col("lo") + F.greatest(F.lit(0.0), F.lit(float(cycle)) - F.col("hi"))
    if not largest and not zero and cycle is not None:
        wrap = F.when(wrap > 0, wrap)
    single = F.lit(INF) if cycle is not None else F.lit(None).cast("double")
    return both.select(F.when(F.col("n") == 1, single).otherwise(pick(F.col("gap"), gap, wrap)).alias("difference"))


def min_difference(df: DataFrame, value: str, cycle: float | None = None, include_zero: bool = False) -> DataFrame:
    """(difference): smallest gap between sorted neighbours; gaps of 0 only count with include_zero. With a cycle, the
    gap over its end counts too. A single value gives infinity with a cycle and null without."""
    return _difference(df, value, cycle, False, include_zero)


def max_difference(df: DataFrame, value: str, cycle: float | None = None) -> DataFrame:
    """(difference): largest gap between sorted neighbours, over the end of the cycle too."""
    return _difference(df, value, cycle, True, True)

"""Running sums over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_buckets(df: DataFrame, value: str, buckets: int | None = None) -> Column:
    """A bucket number that grows with the value, by boundaries fixed beforehand, so that every use agrees."""
    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / n for i in range(1, n)]
    bounds = sorted(set(df.approxQuantile(value, steps, 0.01))) if steps else []
    out = F.lit(0)
    for b in bounds:
        out = out + (F.col(value) > F.lit(b)).cast("int")
    return out


def with_running_sum(df: DataFrame, value: str, summed: str, out: str) -> DataFrame:
    """Adds the sum of `summed` over all rows before each row in the order of `value`, whose values are distinct.

    Rows are sorted within range buckets; the buckets' own totals, a row each, carry over.
    """
    placed = df.withColumn("_bucket", range_buckets(df, value))
    within = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_bucket").agg(F.sum(summed).alias("_own")).withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0.0)))
    joined = placed.join(F.broadcast(totals.select("_bucket", "_before")), "_bucket")  # a row a bucket
    return joined.withColumn(out, F.coalesce(F.sum(summed).over(within), F.lit(0.0)) + F.col("_before")).drop("_bucket", "_before")


def neighbour_gaps(df: DataFrame, value: str) -> DataFrame:
    """(gap): differences between neighbours of the sorted distinct values of `value`."""
    placed = df.withColumn("_bucket", range_buckets(df, value))
    nxt = F.lead(value).over(Window.partitionBy("_bucket").orderBy(value))
    inner = placed.select((nxt - F.col(value)).alias("gap")).filter("gap is not null")
    ends = placed.groupBy("_bucket").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    between = ends.select((F.lead("lo").over(Window.orderBy("_bucket")) - F.col("hi")).alias("gap")).filter("gap is not null")
    return inner.union(between)

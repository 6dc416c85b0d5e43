"""Distance contributions, conviction, divergence and influence, from one neighbour table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import INF, Feature, generalized_distance
from .neighbors import neighbour_table


def _mean(d: Column, exponent: float | str, w: Column | None = None) -> Column:
    """Aggregate: power mean of distances; geometric in surprisal space and for exponent 0."""
    w = F.lit(1.0) if w is None else w
    if isinstance(exponent, str):
        exponent = 1.0 if exponent == "surprisal" else 0.0
    if exponent == 0:
        return F.exp(F.sum(w * F.log(d)) / F.sum(w))
    if exponent == 1:
        return F.sum(w * d) / F.sum(w)
    return F.pow(F.sum(w * F.pow(d, F.lit(float(exponent)))) / F.sum(w), F.lit(1.0 / float(exponent)))


def _contribution(rows: DataFrame, key: list[str], exponent, weighted: bool) -> DataFrame:
    """(key, dc) of neighbour rows that already are the right ones, with z and wi of the source."""
    some = F.col("d") > 0
    mean = _mean(F.when(some, F.col("d")), exponent, F.when(some, F.col("wj")) if weighted else F.when(some, F.lit(1.0)))
    agg = rows.groupBy(*key).agg(mean.alias("m"), F.max("z").alias("z"), F.max("wi").alias("wi"), F.sum(F.when(~some, F.col("wj")).otherwise(0.0)).alias("wz"))
    plain = F.col("m") / (F.col("z") + 1)
    return agg.select(*key, F.coalesce(F.when(F.col("wi") == 0, 0.0).otherwise(F.col("wi") * F.col("m") * F.col("wi") / (F.col("wz") + F.col("wi"))) if weighted else plain, F.lit(0.0)).alias("dc"))


def distance_contributions(
    df: DataFrame, k: int | Sequence[float], features: Sequence[Feature], p: float = 1.0, exponent: float | str = 1.0, surprisal: bool = False,
    id_col: str = "id", weight: str | None = None, queries: DataFrame | None = None,
) -> DataFrame:
    """(id, dc): expected distance of each row to its k nearest others; rows at the same place share it."""
    near = neighbour_table(df, k, features, p, surprisal, id_col, weight, queries, 0, exponent)
    return _contribution(near, ["i"], exponent, weight is not None).withColumnRenamed("i", id_col)


def position_contributions(
    df: DataFrame, positions: DataFrame, k: int, features: Sequence[Feature], p: float = 1.0, exponent: float | str = 1.0,
    surprisal: bool = False, id_col: str = "id", position_col: str = "position",
) -> DataFrame:
    """(position, dc): expected distance of given positions to their k nearest rows. positions: a number and features."""
    from pyspark.sql import Window

    names = [f.name for f in features]
    asked = positions.select(F.col(position_col).alias("i"), *(F.col(n).alias(f"a_{n}") for n in names))
    base = df.select(F.col(id_col).alias("j"), *(F.col(n).alias(f"b_{n}") for n in names))
    d = generalized_distance(features, [F.col(f"a_{n}") for n in names], [F.col(f"b_{n}") for n in names], p, surprisal)
    pairs = base.crossJoin(F.broadcast(asked)).select("i", "j", d.alias("d"))  # the caller's positions
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("r") <= k)
    some = F.when(F.col("d") > 0, F.col("d"))
    out = ranked.groupBy("i").agg((_mean(some, exponent, F.when(F.col("d") > 0, 1.0)) / (F.sum((F.col("d") == 0).cast("int")) + 1)).alias("dc"))
    return out.withColumnRenamed("i", position_col)


def kl_divergences(
    df: DataFrame, k: int, features: Sequence[Feature], p: float = 1.0, exponent: float | str = 1.0, surprisal: bool = False,
    id_col: str = "id", ids: Sequence | None = None, removal: bool = False, weight: str | None = None,
) -> DataFrame:
    """(id, kl): divergence between the rows' contributions and those without the row, for the rows in ids or all.

    Only rows that have the held-out one among their neighbours change, so each row's sums are corrected by those; the
    neighbour table with a spare neighbour a row holds all that is needed.
    """
    near = neighbour_table(df, k, features, p, surprisal, id_col, weight).persist()
    weighted = weight is not None
    reach = F.greatest(F.lit(k), F.col("z") + 1)
    dc = _contribution(near.filter(F.col("r") <= reach), ["i"], exponent, weighted)
    held = near.filter(F.col("r") <= reach).select("i", F.col("j").alias("h"), F.col("r").alias("hr"), (F.col("d") == 0).cast("int").alias("hz"))
    if ids is not None:
        held = held.filter(F.col("h").isin(list(ids)))
    rest = near.join(held, "i").filter("j <> h").withColumn("r", F.col("r") - (F.col("r") > F.col("hr")).cast("int")).withColumn("z", F.col("z") - F.col("hz"))
    changed = _contribution(rest.filter(F.col("r") <= F.greatest(F.lit(k), F.col("z") + 1)), ["i", "h"], exponent, weighted).withColumnRenamed("dc", "fresh")
    totals = dc.agg(F.sum("dc").alias("S"), F.count("*").alias("n"))
    moved = changed.join(dc, "i").withColumn("_", F.lit(1))
    sums = moved.groupBy("h").agg(F.sum("dc").alias("old"), F.sum("fresh").alias("new"))
    asked = dc if ids is None else dc.filter(F.col("i").isin(list(ids)))
    one = asked.withColumnRenamed("i", "h").join(sums, "h", "left").crossJoin(F.broadcast(totals))  # one row
    one = one.na.fill(0.0, ["old", "new"]).withColumn("T", F.col("S") - F.col("dc") - F.col("old") + F.col("new"))
    one = one.withColumn("c", (1 - 1 / F.col("n")) / F.col("T"))  # others' probability is c times their contribution
    terms = moved.select("h", F.col("dc").alias("x"), "fresh").join(one.select("h", "S", "c"), "h")
    P, Q = F.col("x") / F.col("S"), F.col("fresh") * F.col("c")

    def kl(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    part = terms.groupBy("h").agg(F.sum(kl(P, Q) if removal else kl(Q, P)).alias("part"))
    out = one.join(part, "h", "left").na.fill(0.0, ["part"])
    own_p, own_q = F.col("dc") / F.col("S"), 1 / F.col("n")
    same = F.col("S") - F.col("dc") - F.col("old")
    ratio = F.col("c") * F.col("S")
    steady = same / F.col("S") * -F.log(ratio) if removal else same * F.col("c") * F.log(ratio)
    total = F.col("part") + steady + (kl(own_p, own_q) if removal else kl(own_q, own_p))
    return out.select(F.col("h").alias(id_col), F.greatest(total, F.lit(0.0)).alias("kl"))


def convictions(df: DataFrame, k: int, features: Sequence[Feature], **options) -> DataFrame:
    """(id, conviction): mean divergence of the rows asked for, divided by the row's own; 1 for all if the mean is 0."""
    id_col = options.get("id_col", "id")
    kls = kl_divergences(df, k, features, **options)
    mean = kls.agg(F.avg("kl").alias("mean"))
    out = F.when(F.col("mean") == 0, 1.0).when(F.col("kl") == 0, F.lit(0.0)).otherwise(F.col("mean") / F.col("kl"))
    return kls.crossJoin(F.broadcast(mean)).select(id_col, out.alias("conviction"))


def group_kl(
    df: DataFrame, group: Sequence, k: int, features: Sequence[Feature], p: float = 1.0, exponent: float | str = 1.0,
    surprisal: bool = False, id_col: str = "id", removal: bool = False,
) -> DataFrame:
    """(kl): divergence between the contributions of all rows and those of the rows outside of a group of ids."""
    base = df.filter(~F.col(id_col).isin(list(group)))
    whole = distance_contributions(df, k, features, p, exponent, surprisal, id_col)
    part = distance_contributions(base, k, features, p, exponent, surprisal, id_col).withColumnRenamed("dc", "own")
    n = df.count()
    both = whole.join(part, id_col, "left").crossJoin(F.broadcast(whole.agg(F.sum("dc").alias("S"))))
    both = both.crossJoin(F.broadcast(part.agg(F.sum("own").alias("T"), F.count("*").alias("m"))))
    P = F.col("dc") / F.col("S")
    Q = F.when(F.col("own").isNull(), 1.0 / n).otherwise(F.col("own") / F.col("T") * F.col("m") / n)
    a, b = (P, Q) if removal else (Q, P)
    return both.agg(F.greatest(F.sum(F.when(a > 0, a * F.log(a / b)).otherwise(0.0)), F.lit(0.0)).alias("kl"))


def cumulative_weights(
    df: DataFrame, k: int | Sequence[float], features: Sequence[Feature], p: float = 1.0, exponent: float | str = -1.0, surprisal: bool = False,
    id_col: str = "id", weight: str | None = None,
) -> DataFrame:
    """(id, weight): what each row receives when every row spreads its weight over its k nearest by closeness."""
    near = neighbour_table(df, k, features, p, surprisal, id_col, weight, None, 0, exponent)
    near = near.filter(F.col("r") <= k) if isinstance(k, int) else near
    if surprisal or exponent == "surprisal_to_prob":
        t = F.exp(-F.col("d"))
    else:
        t = F.when(F.col("d") == 0, 1e300).otherwise(F.pow("d", F.lit(float(exponent))))
    near = near.withColumn("t", t * F.col("wj"))
    total = near.groupBy("i").agg(F.sum("t").alias("total"))
    got = near.join(total, "i").groupBy("j").agg(F.sum(F.col("wi") * F.col("t") / F.col("total")).alias("weight"))
    return got.filter("weight > 0").withColumnRenamed("j", id_col)


__all__ = ["INF", "convictions", "cumulative_weights", "distance_contributions", "group_kl", "kl_divergences", "position_contributions"]

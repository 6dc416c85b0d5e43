"""Nearest-neighbour and radius search."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distance import INF, Feature, generalized_distance, transform

#: Rows of a table that is paired with itself by broadcasting it; larger ones are dealt out in blocks.
BROADCAST_ROWS = 50_000


def distance_to(features: Sequence[Feature], point: Sequence, p: float = 1.0, surprisal: bool = False) -> Column:
    """Distance of each row to a fixed point."""
    return generalized_distance(features, [F.col(f.name) for f in features], [F.lit(x) for x in point], p, surprisal)


def point_of(df: DataFrame, features: Sequence[Feature], row_id, id_col: str = "id") -> list:
    """The values of one row, to be used as a point."""
    row = df.filter(F.col(id_col) == row_id).select(*(f.name for f in features)).first()
    return [None] * len(features) if row is None else list(row)


def within(
    df: DataFrame, radius: float, features: Sequence[Feature], point: Sequence, p: float = 1.0, surprisal: bool = False,
    radius_col: str | None = None, id_col: str = "id", exclude=None, exponent: float | str = 1.0, weight: str | None = None,
) -> DataFrame:
    """(id, distance) of the rows that lie within a radius of a point; a row's own radius comes off its distance."""
    d = distance_to(features, point, p, surprisal)
    d = d - F.coalesce(F.col(radius_col).cast("double"), F.lit(0.0)) if radius_col else d
    rows = df if exclude is None else df.filter(F.col(id_col) != exclude)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else None
    found = rows.select(F.col(id_col), d.alias("distance"), (w if w is not None else F.lit(1.0)).alias("_w")).filter(F.col("distance") <= radius)
    return found.select(id_col, transform(F.col("distance"), exponent, F.col("_w") if weight else None).alias("distance"))


def nearest(
    df: DataFrame, k: int | Sequence[float], features: Sequence[Feature], point: Sequence, p: float = 1.0, surprisal: bool = False,
    radius_col: str | None = None, id_col: str = "id", exclude=None, exponent: float | str = 1.0, weight: str | None = None,
) -> DataFrame:
    """(id, distance) of the nearest rows to a point, by distance and then id.

    k: their number, or a dynamic bandwidth [least incremental probability, least k, most k, extra k]: rows are added
    while there are fewer than the least k, or the probability gathered is at most 1.25, or the next one still counts.
    """
    d = distance_to(features, point, p, surprisal)
    d = d - F.coalesce(F.col(radius_col).cast("double"), F.lit(0.0)) if radius_col else d
    rows = df if exclude is None else df.filter(F.col(id_col) != exclude)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = rows.select(F.col(id_col), d.alias("d"), w.alias("w")).filter("d is not null")
    out = transform(F.col("d"), exponent, F.col("w") if weight else None).alias("distance")
    if isinstance(k, int):
        return rows.orderBy("d", id_col).limit(k).select(id_col, out)
    band = Bandwidth.of(k).bounded(rows, "w" if weight else None)
    near = rows if band.rows is None else rows.orderBy("d", id_col).limit(band.rows)
    near = near.withColumnRenamed(id_col, "j").withColumn("i", F.lit(0))
    return band.kept(near, exponent, surprisal).select(F.col("j").alias(id_col), out)


@dataclass(frozen=True)
class Bandwidth:
    """How many neighbours count: they are added, nearest first, while there are fewer than `least`, or the probability
    gathered is at most 1.25, or the next one still counts: it has a share of `share` of what is gathered, or is as near
    as the one before; then `extra` more. Never more than `most` before those."""

    share: float
    least: float = 0
    most: float = INF
    extra: int = 0

    @staticmethod
    def of(k: int | Sequence[float]) -> Bandwidth:
        if isinstance(k, int):
            return Bandwidth(0.0, k, k)
        share, least, most, extra = [*k, *(0, 1, INF, 0)[len(k) :]]
        return Bandwidth(share, least, most, int(extra))

    def bounded(self, rows: DataFrame, weight: str | None) -> Bandwidth:
        """With no more than can have the least share: its reciprocal, by the share that the lightest row would take."""
        if self.share <= 0:
            return self
        lightest = rows.agg(F.min(F.when(F.col(weight) > 0, F.col(weight)))).first()[0] if weight else None
        most = min(self.most, math.ceil(1 / (self.share * min(1.0, 1.0 if lightest is None else lightest))))
        return replace(self, most=most, least=min(self.least, most))

    @property
    def rows(self) -> int | None:
        return None if self.most == INF else int(self.most) + self.extra

    def kept(self, near: DataFrame, exponent: float | str, surprisal: bool) -> DataFrame:
        """Of rows (i, j, d, ...) those that belong to the neighbourhood of i, with their rank r."""
        by = Window.partitionBy("i").orderBy("d", "j")
        ranked = near.withColumn("r", F.row_number().over(by))
        if self.share == 0 and self.least == self.most:
            return ranked.filter(F.col("r") <= self.most + self.extra)
        prob = F.exp(-F.col("d")) if surprisal else F.when(F.col("d") == 0, INF).otherwise(F.pow("d", F.lit(-abs(float(exponent if not isinstance(exponent, str) else 1.0)))))
        ranked = ranked.withColumn("_q", prob).withColumn("_total", F.sum("_q").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        ranked = ranked.withColumn("_prev", F.lag("_q").over(by)).withColumn("_q1", F.first("_q").over(by))
        fades = (F.col("_q") / F.col("_total") < self.share) | ((F.col("_q1") - F.col("_q")) / F.col("_q1") >= 0.2)
        stop = (F.col("r") > self.least) & (F.col("_total") > 1.25) & fades & (F.col("_q") != F.col("_prev"))
        if self.most != INF:
            stop = stop | (F.col("r") > self.most)
        ranked = ranked.withColumn("_end", F.min(F.when(stop, F.col("r"))).over(Window.partitionBy("i")))
        return ranked.filter(F.col("_end").isNull() | (F.col("r") < F.col("_end") + self.extra)).drop("_q", "_total", "_prev", "_q1", "_end")


def neighbour_table(
    df: DataFrame, k: int | Sequence[float], features: Sequence[Feature], p: float = 1.0, surprisal: bool = False,
    id_col: str = "id", weight: str | None = None, queries: DataFrame | None = None, spare: int = 1, exponent: float | str = 1.0,
) -> DataFrame:
    """(i, j, d, r, z, wi, wj): for each row i its nearest other rows j, r counting from 1.

    A row keeps k neighbours, or one more than its z neighbours at distance 0 if that is more, and `spare` beyond them,
    which a row left out would bring in; or as many as a dynamic bandwidth, as `nearest` takes it, lets in. Every pair's
    distance is computed; ranks are cut off within tasks before the shuffle.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    names = [f.name for f in features]
    base = df.select(F.col(id_col).alias("j"), w.alias("wj"), *(F.col(n).alias(f"b_{n}") for n in names))
    asked = (queries if queries is not None else df).select(F.col(id_col).alias("i"), w.alias("wi"), *(F.col(n).alias(f"a_{n}") for n in names))
    if asked.count() <= BROADCAST_ROWS:
        pairs = base.crossJoin(F.broadcast(asked))
    else:
        pairs = base.repartition(base.sparkSession.sparkContext.defaultParallelism * 4).crossJoin(asked)
    d = generalized_distance(features, [F.col(f"a_{n}") for n in names], [F.col(f"b_{n}") for n in names], p, surprisal)
    pairs = pairs.filter("i <> j").select("i", "j", d.alias("d"), "wi", "wj").filter("d is not null")
    own = Window.partitionBy("i").orderBy("d", "j")
    zeros = pairs.filter("d = 0").groupBy("i").agg(F.count("*").alias("z"))
    if not isinstance(k, int):
        band = Bandwidth.of(k).bounded(base, "wj" if weight else None)
        near = pairs if band.rows is None else pairs.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= band.rows).drop("r")
        return band.kept(near, exponent, surprisal).join(zeros, "i", "left").na.fill(0, ["z"])
    ranked = pairs.withColumn("r", F.row_number().over(own))
    most = zeros.agg(F.max("z")).first()[0] or 0
    ranked = ranked.filter(F.col("r") <= max(k, most + 1) + spare)
    return ranked.join(zeros, "i", "left").withColumn("z", F.coalesce("z", F.lit(0))).filter(F.col("r") <= F.greatest(F.lit(k), F.col("z") + 1) + spare)

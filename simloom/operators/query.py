"""A query over one table of labelled records: conditions that narrow rows down, then a result.

Rows have an id and labels. In a ragged table an array column `__present` names the labels that a row has; without
that column every row has all. A condition on a label that no row can have (unknown, or private: it starts with "!")
makes the query empty. Conditions hold in their order, which matters for top-k and samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import natural_key
from . import density, neighbors, stats
from .clusters import clusters
from .distance import Feature, fitted

PRESENT = "__present"
#: Lists of ids or values up to this length become a filter; longer ones a semi-join.
SHORT = 200


@dataclass(frozen=True)
class Query:
    df: DataFrame
    id: str = "id"

    # --- conditions -------------------------------------------------------------------------------------------------

    def _ok(self, label: str) -> bool:
        return label in self.df.columns and not label.startswith("!")

    def _kind(self, label: str) -> str:
        return self.df.schema[label].dataType.simpleString()

    def _where(self, label: str, condition) -> Query:
        if not self._ok(label):
            return replace(self, df=self.df.filter(F.lit(False)))
        return replace(self, df=self.df.filter(self.present(label) & condition(F.col(label))))

    def present(self, label: str) -> Column:
        return F.array_contains(PRESENT, label) if PRESENT in self.df.columns else F.lit(True)

    def _typed(self, label: str, value) -> bool:
        """Whether a value has the label's type: 1, "1" and true are all different."""
        kind = self._kind(label)
        if value is None:
            return True
        if kind == "boolean":
            return isinstance(value, bool)
        if kind == "string":
            return isinstance(value, str)
        if kind.startswith("array"):
            return isinstance(value, (list, tuple))
        return not isinstance(value, (bool, str))

    def exists(self, label: str) -> Query:
        return self._where(label, lambda _: F.lit(True))

    def not_exists(self, label: str) -> Query:
        if not self._ok(label):
            return self
        return replace(self, df=self.df.filter(~self.present(label)))

    def equals(self, label: str, value) -> Query:
        return self._where(label, lambda c: c.eqNullSafe(F.lit(value)) if self._typed(label, value) else F.lit(False))

    def not_equals(self, label: str, value) -> Query:
        return self._where(label, lambda c: ~c.eqNullSafe(F.lit(value)) if self._typed(label, value) else F.lit(True))

    def _bounds(self, label: str, low, high) -> tuple[Column, Column]:
        """Whether a value is at or above low, and at or below high; a null bound is open."""
        c = F.col(label)
        if self._kind(label) == "string" and all(x is None or isinstance(x, str) for x in (low, high)):
            c, side = natural_key(c), lambda x: F.concat(natural_key(F.lit(x)))
            # Compared by their natural keys without the raw text, so "a1" is as high as "a 1".
            c, cut = F.substring_index(c, "\u0000", 1), lambda x: F.substring_index(side(x), "\u0000", 1)
        else:
            c, cut = c.cast("double"), lambda x: F.lit(float(x))
        return (c >= cut(low) if low is not None else c.isNotNull()), (c <= cut(high) if high is not None else c.isNotNull())

    def between(self, label: str, low, high) -> Query:
        """Both ends included; null values never; both bounds null: none."""
        if low is None and high is None:
            return self._where(label, lambda _: F.lit(False))
        return self._where(label, lambda _: self._bounds(label, low, high)[0] & self._bounds(label, low, high)[1])

    def not_between(self, label: str, low, high) -> Query:
        return self._where(label, lambda c: c.isNotNull() & ~(self._bounds(label, low, high)[0] & self._bounds(label, low, high)[1]))

    def at_most(self, label: str, value) -> Query:
        return self.between(label, None, value)

    def at_least(self, label: str, value) -> Query:
        return self.between(label, value, None)

    def _in(self, label: str, values: Sequence) -> Column:
        own = [v for v in values if v is not None and self._typed(label, v)]
        found = F.coalesce(F.col(label).isin(own), F.lit(False)) if own else F.lit(False)
        return found | F.col(label).isNull() if None in values else found

    def among(self, label: str, values: Sequence) -> Query:
        return self._where(label, lambda _: self._in(label, values))

    def not_among(self, label: str, values: Sequence) -> Query:
        return self._where(label, lambda _: ~self._in(label, values))

    def _listed(self, ids: Sequence, how: str) -> Query:
        spark, ids = self.df.sparkSession, list(ids)
        if len(ids) <= SHORT:
            c = F.coalesce(F.col(self.id).isin(ids), F.lit(False)) if ids else F.lit(False)
            return replace(self, df=self.df.filter(c if how == "left_semi" else ~c))
        other = spark.createDataFrame([(x,) for x in ids], f"{self.id} {self._kind(self.id)}").distinct()
        return replace(self, df=self.df.join(other, self.id, how))

    def in_ids(self, ids: Sequence) -> Query:
        return self._listed(ids, "left_semi")

    def not_in_ids(self, ids: Sequence) -> Query:
        return self._listed(ids, "left_anti")

    def _top(self, label: str, n: int, numeric: bool, descending: bool) -> Query:
        kind = self._kind(label) if self._ok(label) else ""
        if not kind or numeric == (kind in ("string", "boolean")):
            return self._where(label, lambda _: F.lit(False))
        key = natural_key(F.col(label)) if kind == "string" else F.col(label).cast("double")
        own = self._where(label, lambda c: c.isNotNull()).df
        return replace(self, df=own.orderBy(key.desc() if descending else key.asc(), self.id).limit(n))

    def max(self, label: str, n: int = 1, numeric: bool = True) -> Query:
        return self._top(label, n, numeric, True)

    def min(self, label: str, n: int = 1, numeric: bool = True) -> Query:
        return self._top(label, n, numeric, False)

    def select(self, n: int, offset: int = 0, seed: int | None = None) -> Query:
        """n rows from an offset in the order of ids, or with a seed in a shuffled order that the seed fixes."""
        order = [self.id] if seed is None else [F.xxhash64(F.lit(seed), F.col(self.id)), self.id]
        return replace(self, df=self.df.orderBy(*order).offset(offset).limit(n))

    def sample(self, n: int, weight: str | None = None, seed: int = 0) -> Query:
        """n draws with replacement, in proportion to the weights; a row may come more than once.

        Each draw is a number below the total weight and meets the row whose stretch of the running sum holds it.
        """
        from pyspark.sql import Window

        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
        keyed = self.df.withColumn("_w", w).filter("_w > 0")
        keyed = keyed.withColumn("_b", F.pmod(F.xxhash64(self.id), F.lit(256)))
        run = Window.partitionBy("_b").orderBy(self.id).rowsBetween(Window.unboundedPreceding, 0)
        keyed = keyed.withColumn("_hi", F.sum("_w").over(run))
        per = keyed.groupBy("_b").agg(F.sum("_w").alias("_own"))
        per = per.withColumn("_end", F.sum("_own").over(Window.orderBy("_b"))).withColumn("_start", F.col("_end") - F.col("_own"))
        total = per.agg(F.max("_end").alias("_t"))
        u = (F.pmod(F.xxhash64(F.lit(seed), F.col("draw")), F.lit(1 << 53)) / float(1 << 53)) * F.col("_t")
        draws = self.df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).select("draw", u.alias("_u"))
        dealt = draws.join(F.broadcast(per), (F.col("_u") >= F.col("_start")) & (F.col("_u") < F.col("_end"))).select("draw", "_b", (F.col("_u") - F.col("_start")).alias("_u"))
        found = keyed.join(dealt, "_b").filter((F.col("_u") < F.col("_hi")) & (F.col("_u") >= F.col("_hi") - F.col("_w")))
        return replace(self, df=found.drop("_w", "_b", "_hi", "_u"))

    # --- results ----------------------------------------------------------------------------------------------------

    def ids(self) -> DataFrame:
        return self.df.select(self.id)

    def labels(self, *names: str) -> DataFrame:
        return self.df.select(self.id, *names)

    def sum(self, label: str, weight: str | None = None) -> DataFrame:
        return stats.weighted_sum(self.exists(label).df, label, weight)

    def mode(self, label: str, weight: str | None = None) -> DataFrame:
        return stats.mode(self.exists(label).df, label, weight)

    def quantile(self, label: str, q: float, weight: str | None = None) -> DataFrame:
        return stats.quantile(self.exists(label).df, label, q, weight)

    def generalized_mean(self, label: str, p: float = 1.0, weight: str | None = None, **options) -> DataFrame:
        return stats.generalized_mean(self.exists(label).df, label, p, weight, **options)

    def min_difference(self, label: str, cycle: float | None = None, include_zero: bool = False) -> DataFrame:
        return stats.min_difference(self.exists(label).df, label, cycle, include_zero)

    def max_difference(self, label: str, cycle: float | None = None) -> DataFrame:
        return stats.max_difference(self.exists(label).df, label, cycle)

    def value_masses(self, label: str, weight: str | None = None) -> DataFrame:
        return stats.value_masses(self.exists(label).df, label, weight)

    def _having(self, features: Sequence[Feature]) -> DataFrame:
        q = self
        for f in features:
            q = q.exists(f.name)
        return q.df

    def within(self, radius: float, features: Sequence[Feature], point: Sequence, **options) -> DataFrame:
        rows = self._having(features)
        return neighbors.within(rows, radius, fitted(rows, features, options.get("surprisal", False), point), point, id_col=self.id, **options)

    def nearest(self, k, features: Sequence[Feature], point: Sequence, **options) -> DataFrame:
        rows = self._having(features)
        return neighbors.nearest(rows, k, fitted(rows, features, options.get("surprisal", False), point), point, id_col=self.id, **options)

    def nearest_to(self, k, features: Sequence[Feature], row_id, **options) -> DataFrame:
        """The nearest others of a row of the table."""
        rows = self._having(features)
        point = neighbors.point_of(rows, features, row_id, self.id)
        return neighbors.nearest(rows, k, fitted(rows, features, options.get("surprisal", False), point), point, id_col=self.id, exclude=row_id, **options)

    def position_contributions(self, positions: DataFrame, k: int, features: Sequence[Feature], **options) -> DataFrame:
        rows = self._having(features)
        return density.position_contributions(rows, positions, k, fitted(rows, features, options.get("surprisal", False)), id_col=self.id, **options)

    def distance_contributions(self, k: int, features: Sequence[Feature], **options) -> DataFrame:
        rows = self._having(features)
        return density.distance_contributions(rows, k, fitted(rows, features, options.get("surprisal", False)), id_col=self.id, **options)

    def kl_divergences(self, k: int, features: Sequence[Feature], **options) -> DataFrame:
        rows = self._having(features)
        return density.kl_divergences(rows, k, fitted(rows, features, options.get("surprisal", False)), id_col=self.id, **options)

    def convictions(self, k: int, features: Sequence[Feature], **options) -> DataFrame:
        rows = self._having(features)
        return density.convictions(rows, k, fitted(rows, features, options.get("surprisal", False)), id_col=self.id, **options)

    def group_kl(self, group: Sequence, k: int, features: Sequence[Feature], **options) -> DataFrame:
        rows = self._having(features)
        return density.group_kl(rows, group, k, fitted(rows, features, options.get("surprisal", False)), id_col=self.id, **options)

    def cumulative_weights(self, k: int, features: Sequence[Feature], **options) -> DataFrame:
        rows = self._having(features)
        return density.cumulative_weights(rows, k, fitted(rows, features, options.get("surprisal", False)), id_col=self.id, **options)

    def clusters(self, k: int, least_weight: float, features: Sequence[Feature], **options) -> DataFrame:
        rows = self._having(features)
        return clusters(rows, k, least_weight, fitted(rows, features, options.get("surprisal", False)), id_col=self.id, **options)

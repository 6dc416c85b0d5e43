"""Registered table queries: conditions, statistics, distances, density and records, with SQL where it can say the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import records
from ..operators.distance import Feature
from ..operators.query import Query

# The tables as containers of records: table and id.
TABLES = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "events": "event_id", "embeddings": "vec_id", "nation": "n_nationkey"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(table: str, make):
    return lambda spark, sf_dir: make(Query(read(spark, sf_dir, table), TABLES[table]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(read(spark, sf_dir, "lineitem"), "l_orderkey")
    return q.exists("l_quantity").between("l_discount", 0.05, 0.07).sum("l_extendedprice", "l_discount").select(F.round("sum", 2).alias("sum"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Stated points, groups and features of the distance queries.
SUPPLIER = [Feature("s_acctbal", weight=0.001), Feature("s_nationkey", "nominal", weight=2.0)]
SUPPLIER_D = "0.001 * abs(a.s_acctbal - b.s_acctbal) + 2.0 * (a.s_nationkey <> b.s_nationkey)::INT"
CUSTOMER = [Feature("c_acctbal", weight=0.01), Feature("c_nationkey", "cyclic", cycle=25.0), Feature("c_mktsegment", "nominal", weight=3.0)]
CUSTOMER_POINT = (1000.0, 3, "HOUSEHOLD")
CUSTOMER_D = "0.01 * abs(c_acctbal - 1000.0) + least(abs(c_nationkey - 3) % 25, 25 - abs(c_nationkey - 3) % 25) + 3.0 * (c_mktsegment <> 'HOUSEHOLD')::INT"
PART = [Feature("p_size"), Feature("p_retailprice", weight=0.01)]
PART_D = "sqrt((p_size - 25) * (p_size - 25) + 0.01 * (p_retailprice - 1000.0) * (p_retailprice - 1000.0))"
NOISY = [Feature("p_size", deviation=2.0), Feature("p_retailprice", deviation=50.0)]
NOISY_D = """0.5 * CASE WHEN p_size = 25 THEN 0 ELSE (abs(p_size - 25) + 0.5 * exp(-abs(p_size - 25) / 2.0) * (6.0 + abs(p_size - 25))) / 2.0 - 1.5 END
  + 0.5 * CASE WHEN p_retailprice = 1000.0 THEN 0 ELSE (abs(p_retailprice - 1000.0) + 0.5 * exp(-abs(p_retailprice - 1000.0) / 50.0) * (150.0 + abs(p_retailprice - 1000.0))) / 50.0 - 1.5 END"""

NEAR_SQL = f"""WITH d AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, {SUPPLIER_D} AS d FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d)"""

#: Contributions of all rows (dc), and of each row i among the rows but h (wo); p and q are the two distributions.
KL_SQL = f"""{NEAR_SQL}, dc AS (SELECT i, avg(d) AS dc, sum(avg(d)) OVER () AS s, count(*) OVER () AS n FROM r WHERE r <= 5 GROUP BY i),
f AS (SELECT h.s_suppkey AS h, r.i, r.d, row_number() OVER (PARTITION BY h.s_suppkey, r.i ORDER BY r.r) AS k
      FROM supplier h JOIN r ON r.i <> h.s_suppkey AND r.j <> h.s_suppkey AND r.r <= 6),
wo AS (SELECT h, i, avg(d) AS dc FROM f WHERE k <= 5 GROUP BY h, i),
pq AS (SELECT wo.h, dc.dc / dc.s AS p, wo.dc / sum(wo.dc) OVER (PARTITION BY wo.h) * (dc.n - 1) / dc.n AS q FROM wo JOIN dc USING (i)
       UNION ALL SELECT i, dc / s, 1.0 / n FROM dc),
kl AS (SELECT h AS s_suppkey, greatest(sum(q * ln(q / p)), 0) AS kl, greatest(sum(p * ln(p / q)), 0) AS removal FROM pq GROUP BY h)"""
GROUP_KL_SQL = f"""{NEAR_SQL}, dc AS (SELECT i, avg(d) AS dc, sum(avg(d)) OVER () AS s, count(*) OVER () AS n FROM r WHERE r <= 5 GROUP BY i),
f AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY r) AS k FROM r WHERE i >= 5 AND j >= 5),
own AS (SELECT i, avg(d) AS own, sum(avg(d)) OVER () AS t, count(*) OVER () AS m FROM f WHERE k <= 5 GROUP BY i),
pq AS (SELECT dc / s AS p, coalesce(own / t * m / n, 1.0 / n) AS q FROM dc LEFT JOIN own USING (i))
SELECT round(greatest(sum(q * ln(q / p)), 0), 9) AS kl FROM pq"""
#: At most 20 neighbours can have a share of 0.05; they end where one fades.
BANDWIDTH_SQL = f"""WITH d AS (SELECT p_partkey, p_size, {PART_D} AS d FROM part ORDER BY d, p_partkey LIMIT 20),
q AS (SELECT *, CASE WHEN d = 0 THEN 'inf'::DOUBLE ELSE 1 / d END AS q, row_number() OVER (ORDER BY d, p_partkey) AS r FROM d),
w AS (SELECT *, sum(q) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total, lag(q) OVER (ORDER BY r) AS prev, first(q) OVER (ORDER BY r) AS q1 FROM q),
e AS (SELECT min(r) AS stop FROM w WHERE r > 3 AND total > 1.25 AND (q / total < 0.05 OR (q1 - q) / q1 >= 0.2) AND q <> prev)
SELECT p_partkey, round(q * p_size, 6) AS distance FROM w, e WHERE r < coalesce(stop, 1000)"""
GAPS = "WITH v AS (SELECT DISTINCT value AS v FROM events), g AS (SELECT lead(v) OVER (ORDER BY v) - v AS gap FROM v)"


def _lists(lo: int, hi: int, step: int) -> list[int]:
    return list(range(lo, hi, step))


def _updates(q: Query) -> DataFrame:
    return q.df.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit(1.5).alias("s_acctbal"), F.lit("!").alias("s_name"))


def _two(q: Query) -> tuple[DataFrame, DataFrame]:
    """Two versions of a table: one lacks a tenth of the rows, the other has changed balances and lacks others."""
    a = q.df.filter("s_suppkey % 10 <> 0")
    return a, q.df.filter("s_suppkey % 10 <> 1").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))


TWO_SQL = """WITH a AS (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0),
b AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 1)"""

ORDER_COLS = "o_orderkey, o_totalprice"
QUERIES = {
    # conditions
    "contained_ids": (on("orders", lambda q: q.equals("o_orderstatus", "F").ids()), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "compute_last": (on("orders", lambda q: q.equals("o_orderstatus", "F").at_least("o_totalprice", 100000).value_masses("o_orderpriority")),
                     "SELECT o_orderpriority AS value, count(*)::DOUBLE AS mass FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 GROUP BY 1"),
    "select_limit": (on("orders", lambda q: q.select(50, 10).ids()), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 50 OFFSET 10"),
    "select_seeded": (on("orders", lambda q: q.select(50, 10, seed=3).ids()), None),
    "sample_uniform": (on("orders", lambda q: q.sample(500, seed=1).ids()), None),
    "sample_weighted": (on("orders", lambda q: q.sample(500, "o_totalprice", seed=1).ids()), None),
    "in_ids": (on("orders", lambda q: q.in_ids(_lists(0, 5000, 7)).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_orderkey < 5000 AND o_orderkey % 7 = 0"),
    "not_in_ids": (on("orders", lambda q: q.not_in_ids(_lists(0, 5000, 7)).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE NOT (o_orderkey < 5000 AND o_orderkey % 7 = 0)"),
    "exists": (on("orders", lambda q: q.exists("o_totalprice").labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders"),
    "not_exists": (on("orders", lambda q: q.not_exists("o_totalprice").ids()), "SELECT o_orderkey FROM orders WHERE false"),
    "private_label": (on("orders", lambda q: q.exists("!o_totalprice").ids()), "SELECT o_orderkey FROM orders WHERE false"),
    "equals": (on("orders", lambda q: q.equals("o_orderpriority", "1-URGENT").labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "equals_other_type": (on("orders", lambda q: q.equals("o_orderpriority", 1).ids()), "SELECT o_orderkey FROM orders WHERE false"),
    "not_equals": (on("orders", lambda q: q.not_equals("o_orderstatus", "O").labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_orderstatus <> 'O'"),
    "between": (on("orders", lambda q: q.between("o_totalprice", 50000, 90000).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_totalprice BETWEEN 50000 AND 90000"),
    "between_natural": (on("part", lambda q: q.between("p_brand", "Brand#2", "Brand#10").labels("p_brand")), "SELECT p_partkey, p_brand FROM part WHERE substr(p_brand, 7)::INT BETWEEN 2 AND 10"),
    "not_between": (on("orders", lambda q: q.not_between("o_totalprice", 50000, 400000).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_totalprice < 50000 OR o_totalprice > 400000"),
    "among": (on("orders", lambda q: q.among("o_orderpriority", ["1-URGENT", "5-LOW"]).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "not_among": (on("orders", lambda q: q.not_among("o_orderpriority", ["1-URGENT", "5-LOW"]).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    "max": (on("orders", lambda q: q.max("o_totalprice", 25).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "min": (on("orders", lambda q: q.min("o_totalprice", 25).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25"),
    "max_text": (on("part", lambda q: q.max("p_brand", 25, False).labels("p_brand")), "SELECT p_partkey, p_brand FROM part ORDER BY substr(p_brand, 7)::INT DESC, p_partkey LIMIT 25"),
    "at_most": (on("orders", lambda q: q.at_most("o_totalprice", 50000).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_totalprice <= 50000"),
    "at_least": (on("orders", lambda q: q.at_least("o_totalprice", 400000).labels("o_totalprice")), f"SELECT {ORDER_COLS} FROM orders WHERE o_totalprice >= 400000"),
    # statistics
    "weighted_sum": (flagship, "SELECT round(sum(l_extendedprice * l_discount), 2) AS sum FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07"),
    "sum": (on("orders", lambda q: rounded(q.sum("o_totalprice"), 2)), "SELECT round(sum(o_totalprice), 2) AS sum FROM orders"),
    "mode": (on("part", lambda q: q.mode("p_size")), "SELECT mode FROM (SELECT p_size AS mode, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"),
    "mode_weighted": (on("part", lambda q: q.mode("p_brand", "p_retailprice")), "SELECT mode FROM (SELECT p_brand AS mode, sum(p_retailprice) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"),
    "quantile": (on("orders", lambda q: rounded(q.quantile("o_totalprice", 0.37))), "SELECT round(quantile_cont(o_totalprice, 0.37), 6) AS quantile FROM orders"),
    "quantile_weighted": (on("part", lambda q: rounded(q.quantile("p_retailprice", 0.4, "p_size"))),
        """WITH s AS (SELECT p_retailprice AS v, p_size AS w, sum(p_size) OVER (ORDER BY p_retailprice, p_size, p_partkey) - p_size / 2 AS c FROM part),
        t AS (SELECT 0.4 * sum(p_size) AS t FROM part), lo AS (SELECT v, c FROM s, t WHERE c <= t ORDER BY c DESC LIMIT 1), hi AS (SELECT v, c FROM s, t WHERE c > t ORDER BY c LIMIT 1)
        SELECT round(lo.v + (hi.v - lo.v) * (t - lo.c) / (hi.c - lo.c), 6) AS quantile FROM lo, hi, t"""),
    "mean_arithmetic": (on("part", lambda q: rounded(q.generalized_mean("p_retailprice"))), "SELECT round(avg(p_retailprice), 6) AS mean FROM part"),
    "mean_weighted": (on("part", lambda q: rounded(q.generalized_mean("p_retailprice", 1.0, "p_size"))), "SELECT round(sum(p_retailprice * p_size) / sum(p_size), 6) AS mean FROM part"),
    "mean_geometric": (on("part", lambda q: rounded(q.generalized_mean("p_retailprice", 0))), "SELECT round(exp(avg(ln(p_retailprice))), 6) AS mean FROM part"),
    "mean_harmonic": (on("part", lambda q: rounded(q.generalized_mean("p_retailprice", -1))), "SELECT round(1 / avg(1 / p_retailprice), 6) AS mean FROM part"),
    "mean_quadratic": (on("part", lambda q: rounded(q.generalized_mean("p_retailprice", 2))), "SELECT round(sqrt(avg(p_retailprice * p_retailprice)), 6) AS mean FROM part"),
    "moment": (on("part", lambda q: rounded(q.generalized_mean("p_size", 3, center=25.0, moment=True))), "SELECT round(avg(pow(p_size - 25, 3)), 6) AS mean FROM part"),
    "min_difference": (on("events", lambda q: rounded(q.min_difference("value"))), f"{GAPS} SELECT round(min(gap), 6) AS difference FROM g"),
    "min_difference_zero": (on("events", lambda q: q.min_difference("value", include_zero=True)), "SELECT CASE WHEN count(*) > count(DISTINCT value) THEN 0.0::DOUBLE END AS difference FROM events"),
    "max_difference": (on("events", lambda q: rounded(q.max_difference("value"))), f"{GAPS} SELECT round(max(gap), 6) AS difference FROM g"),
    "max_difference_cycle": (on("events", lambda q: rounded(q.max_difference("value", 1000.0))), f"{GAPS} SELECT round(greatest((SELECT max(gap) FROM g), min(v) + greatest(0, 1000 - max(v))), 6) AS difference FROM v"),
    "value_masses": (on("part", lambda q: q.value_masses("p_brand")), "SELECT p_brand AS value, count(*)::DOUBLE AS mass FROM part GROUP BY 1"),
    "value_masses_weighted": (on("part", lambda q: rounded(q.value_masses("p_brand", "p_retailprice"), 3)), "SELECT p_brand AS value, round(sum(p_retailprice), 3) AS mass FROM part GROUP BY 1"),
    # distances
    "within": (on("customer", lambda q: rounded(q.within(12.0, CUSTOMER, CUSTOMER_POINT))), f"SELECT c_custkey, round({CUSTOMER_D}, 6) AS distance FROM customer WHERE {CUSTOMER_D} <= 12"),
    "nearest": (on("customer", lambda q: rounded(q.nearest(20, CUSTOMER, CUSTOMER_POINT))), f"SELECT c_custkey, round({CUSTOMER_D}, 6) AS distance FROM customer ORDER BY {CUSTOMER_D}, c_custkey LIMIT 20"),
    "nearest_euclidean": (on("part", lambda q: rounded(q.nearest(20, PART, (25, 1000.0), p=2))), f"SELECT p_partkey, round({PART_D}, 6) AS distance FROM part ORDER BY {PART_D}, p_partkey LIMIT 20"),
    "nearest_largest": (on("part", lambda q: q.nearest(20, [Feature("p_size"), Feature("p_retailprice")], (25, 1000.0), p=math.inf)),
                        "SELECT p_partkey, greatest(abs(p_size - 25), abs(p_retailprice - 1000.0)) AS distance FROM part ORDER BY distance, p_partkey LIMIT 20"),
    "nearest_geometric": (on("part", lambda q: rounded(q.nearest(20, [Feature("p_size"), Feature("p_retailprice")], (25, 1000.05), p=0))),
                          "SELECT p_partkey, round(abs(p_size - 25) * abs(p_retailprice - 1000.05), 6) AS distance FROM part ORDER BY abs(p_size - 25) * abs(p_retailprice - 1000.05), p_partkey LIMIT 20"),
    "nearest_surprisal": (on("part", lambda q: rounded(q.nearest(20, NOISY, (25, 1000.0), surprisal=True, exponent="surprisal"))),
                          f"SELECT p_partkey, round({NOISY_D}, 6) AS distance FROM part ORDER BY {NOISY_D}, p_partkey LIMIT 20"),
    "nearest_probability": (on("part", lambda q: rounded(q.nearest(20, NOISY, (25, 1000.0), surprisal=True, exponent="surprisal_to_prob"))),
                            f"SELECT p_partkey, round(exp(-({NOISY_D})), 6) AS distance FROM part ORDER BY {NOISY_D}, p_partkey LIMIT 20"),
    "nearest_to_row": (on("supplier", lambda q: rounded(q.nearest_to(10, SUPPLIER, 5))),
                       f"SELECT b.s_suppkey, round({SUPPLIER_D}, 6) AS distance FROM supplier a JOIN supplier b ON a.s_suppkey = 5 AND b.s_suppkey <> 5 ORDER BY {SUPPLIER_D}, b.s_suppkey LIMIT 10"),
    "nearest_bandwidth": (on("part", lambda q: rounded(q.nearest([0.05, 3, 30], PART, (25, 1000.0), p=2, exponent=-1, weight="p_size"))), BANDWIDTH_SQL),
    "position_contributions": (lambda spark, sf_dir: rounded(Query(read(spark, sf_dir, "part"), "p_partkey").position_contributions(
        spark.createDataFrame([(0, 25, 1000.0), (1, 1, 950.0)], "position int, p_size int, p_retailprice double"), 5, PART, p=2, exponent=1.0)),
        """WITH q(position, s, r) AS (VALUES (0, 25, 1000.0::DOUBLE), (1, 1, 950.0::DOUBLE)), d AS (SELECT position, p_partkey, sqrt((p_size - s) * (p_size - s) + 0.01 * (p_retailprice - r) * (p_retailprice - r)) AS d FROM part, q),
        r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY d, p_partkey) AS r FROM d)
        SELECT position, round(avg(d) FILTER (d > 0) / (count(*) FILTER (d = 0) + 1), 6) AS dc FROM r WHERE r <= 5 GROUP BY 1"""),
    "distance_contributions": (on("supplier", lambda q: rounded(q.distance_contributions(5, SUPPLIER))), f"{NEAR_SQL} SELECT i AS s_suppkey, round(avg(d), 6) AS dc FROM r WHERE r <= 5 GROUP BY i"),
    "kl_divergences": (on("supplier", lambda q: rounded(q.kl_divergences(5, SUPPLIER), 9)), f"{KL_SQL} SELECT s_suppkey, round(kl, 9) AS kl FROM kl"),
    "kl_removal": (on("supplier", lambda q: rounded(q.kl_divergences(5, SUPPLIER, removal=True), 9)), f"{KL_SQL} SELECT s_suppkey, round(removal, 9) AS kl FROM kl"),
    "convictions": (on("supplier", lambda q: rounded(q.convictions(5, SUPPLIER))),
        f"{KL_SQL} SELECT s_suppkey, round(CASE WHEN kl = 0 THEN 0 ELSE avg(kl) OVER () / kl END, 6) AS conviction FROM kl"),
    "group_kl": (on("supplier", lambda q: rounded(q.group_kl(list(range(5)), 5, SUPPLIER), 9)), GROUP_KL_SQL),
    "cumulative_weights": (on("supplier", lambda q: rounded(q.cumulative_weights(5, SUPPLIER))),
        f"{NEAR_SQL}, t AS (SELECT i, j, 1 / d / sum(1 / d) OVER (PARTITION BY i) AS w FROM r WHERE r <= 5) SELECT j AS s_suppkey, round(sum(w), 6) AS weight FROM t GROUP BY j"),
    "clusters": (on("supplier", lambda q: q.clusters(5, 4.0, SUPPLIER)), None),
    # records
    "create": (on("supplier", lambda q: records.create(q.df.filter("s_suppkey < 50"), q.df.filter("s_suppkey >= 40"), "s_suppkey")), "SELECT * FROM supplier"),
    "clone": (on("supplier", lambda q: records.clone(q.df, 3, 100000, "s_suppkey")), "SELECT * FROM supplier UNION ALL SELECT 100000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey = 3"),
    "move": (on("supplier", lambda q: records.move(q.df, 3, 100000, "s_suppkey").withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))), "SELECT CASE WHEN s_suppkey = 3 THEN 100000 ELSE s_suppkey END AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"),
    "destroy": (on("supplier", lambda q: records.destroy(q.df, [1, 2, 3], "s_suppkey")), "SELECT * FROM supplier WHERE s_suppkey NOT IN (1, 2, 3)"),
    "replace_rows": (on("supplier", lambda q: records.replace_rows(q.df, q.df.filter("s_suppkey = 1").withColumn("s_name", F.lit("x")), "s_suppkey")), "SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN 'x' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier"),
    "assign": (on("supplier", lambda q: records.assign(q.df, _updates(q), "s_suppkey")), "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '!' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 1.5::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "accumulate": (on("supplier", lambda q: rounded(records.accumulate(q.df, _updates(q), "s_suppkey"))), "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' ELSE s_name END AS s_name, s_nationkey, round(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1.5 ELSE s_acctbal END, 6) AS s_acctbal FROM supplier"),
    "remove_labels": (on("supplier", lambda q: records.remove_labels(q.df, ["s_name"], [1, 2], "s_suppkey")), "SELECT s_suppkey, CASE WHEN s_suppkey NOT IN (1, 2) THEN s_name END AS s_name, s_nationkey, s_acctbal FROM supplier"),
    "retrieve": (on("supplier", lambda q: records.retrieve(q.df, 7, ["s_name", "s_acctbal"], "s_suppkey")), "SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey = 7"),
    "retrieve_root": (on("nation", lambda q: records.retrieve_root(q.df, 7, "n_nationkey")), "SELECT '{\"n_nationkey\":7,\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS root FROM nation WHERE n_nationkey = 7"),
    "flatten_rebuild": (on("nation", lambda q: records.rebuild(records.flatten(q.df, "n_nationkey"), "n_name string, n_regionkey int", "n_nationkey")), "SELECT * FROM nation"),
    "call_on": (on("supplier", lambda q: records.call_on(q.df, {"twice": F.col("s_acctbal") * 2}, "s_suppkey")), "SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier"),
    "records_intersect": (on("supplier", lambda q: records.intersect(*_two(q), "s_suppkey")), f"{TWO_SQL} SELECT a.s_suppkey, a.s_name, a.s_nationkey, CASE WHEN a.s_acctbal = b.s_acctbal THEN a.s_acctbal END AS s_acctbal FROM a JOIN b ON a.s_suppkey = b.s_suppkey"),
    "records_union": (on("supplier", lambda q: records.union(*_two(q), "s_suppkey")), f"{TWO_SQL} SELECT coalesce(b.s_suppkey, a.s_suppkey) AS s_suppkey, coalesce(b.s_name, a.s_name) AS s_name, coalesce(b.s_nationkey, a.s_nationkey) AS s_nationkey, coalesce(b.s_acctbal, a.s_acctbal) AS s_acctbal FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey"),
    "records_difference": (on("supplier", lambda q: records.difference(*_two(q), "s_suppkey").withColumn("labels", F.array_join("labels", ","))),
        f"{TWO_SQL} SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'added' WHEN b.s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.s_suppkey IS NOT NULL AND b.s_suppkey IS NOT NULL THEN 's_acctbal' ELSE '' END AS labels FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.s_suppkey IS NULL OR b.s_suppkey IS NULL OR a.s_acctbal <> b.s_acctbal"),
    "records_patch": (on("supplier", lambda q: records.patch(*_two(q), "s_suppkey")), f"{TWO_SQL} SELECT * FROM b"),
    "records_mix": (on("supplier", lambda q: records.mix(*_two(q), 0.5, 0.5, 1, "s_suppkey")), None),
    "records_mutate": (on("supplier", lambda q: records.mutate(q.df, 0.3, seed=2, id_col="s_suppkey")), None),
    "records_commonality": (on("supplier", lambda q: records.commonality(*_two(q), "s_suppkey")), f"{TWO_SQL} SELECT sum(3 + (a.s_acctbal = b.s_acctbal)::INT)::DOUBLE AS commonality FROM a JOIN b ON a.s_suppkey = b.s_suppkey"),
    "records_edit_distance": (on("supplier", lambda q: records.edit_distance(*_two(q), "s_suppkey")),
        f"{TWO_SQL} SELECT ((SELECT count(*) FROM a) * 4 + (SELECT count(*) FROM b) * 4 - 2 * sum(3 + (a.s_acctbal = b.s_acctbal)::INT))::DOUBLE AS distance FROM a JOIN b ON a.s_suppkey = b.s_suppkey"),
    "records_size": (on("supplier", lambda q: records.total_size(q.df)), "SELECT count(*) * 4.0::DOUBLE AS size FROM supplier"),
    "set_value": (on("supplier", lambda q: metadata.set_value(metadata.set_note(q.df, "s_acctbal", "balance"), "s_acctbal", F.col("s_acctbal") * 2)), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier"),
    "get_comment": (lambda spark, sf_dir: spark.createDataFrame([(metadata.get_note(metadata.set_note(read(spark, sf_dir, "supplier"), "s_acctbal", "balance"), "s_acctbal"),)], "comment string"), "SELECT 'balance' AS comment"),
    "contains_record": (lambda spark, sf_dir: spark.createDataFrame([(records.contains(read(spark, sf_dir, "supplier"), 7, "s_suppkey"), records.contains(read(spark, sf_dir, "supplier"), -7, "s_suppkey"))], "here boolean, there boolean"), "SELECT true AS here, false AS there"),
}


def queries() -> dict:
    return {f"q_{n}": f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"q_{n}": sql for n, (_, sql) in QUERIES.items() if sql}

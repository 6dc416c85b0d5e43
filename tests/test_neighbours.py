"""Bandwidths, statistics taken from the data, and text functions against plain versions."""

import math
import random

from pyspark.sql import functions as F

from simloom.functions import strings
from simloom.operators.distance import Feature, fitted
from simloom.operators.neighbors import nearest, neighbour_table
from simloom.operators.query import Query


def table(spark, n=40):
    r = random.Random(4)
    return spark.createDataFrame([(i, round(r.uniform(0, 100), 3), r.choice("abc"), r.choice([0.1, 0.5, 2.0])) for i in range(n)], "id int, x double, c string, w double")


def plain_bandwidth(d, share, least, most, extra):
    """Neighbours by distance: how many of them stay, at exponent -1."""
    most = min(most, math.ceil(1 / share))
    least = min(least, most)
    total, first, prev = 0.0, None, None
    for r, x in enumerate(sorted(d), 1):
        q = math.inf if x == 0 else 1 / x
        first = q if first is None else first
        if r > most or r > least and total > 1.25 and (q / total < share or (first - q) / first >= 0.2) and q != prev:
            return min(len(d), r - 1 + extra)
        total, prev = total + q, q
    return len(d)


def test_bandwidth_for_each_row(spark):
    df = table(spark)
    rows = {r["id"]: r["x"] for r in df.collect()}
    for band in ([0.05, 3, 30], [0.1, 1, math.inf], [0.2, 2, 10, 2]):
        near = neighbour_table(df, band, [Feature("x")], exponent=-1)
        sizes = {r["i"]: r["count"] for r in near.groupBy("i").count().collect()}
        share, least, most, extra = [*band, 0][:4]
        for i, x in rows.items():
            assert sizes[i] == plain_bandwidth([abs(x - y) for j, y in rows.items() if j != i], share, least, most, extra), (band, i)
    assert Query(df).distance_contributions([0.1, 2, 10], [Feature("x")]).count() == len(rows)


def test_light_rows_are_not_cut(spark):
    """All at the same distance: none is less likely than the one before, so only the least share bounds them."""
    df = spark.createDataFrame([(i, 1.0, 0.1) for i in range(300)], "id int, x double, w double")
    assert nearest(df, [0.05, 1], [Feature("x")], [0.0], weight="w").count() == 200
    assert nearest(df, [0.05, 1], [Feature("x")], [0.0]).count() == 20
    assert nearest(df, [0.0, 1], [Feature("x")], [0.0]).count() == 300


def test_statistics_from_the_data(spark):
    df = table(spark)
    x = [r["x"] for r in df.collect()]
    a, b, c = fitted(df, [Feature("x"), Feature("c", "nominal", deviation=0.1), Feature("x", "cyclic", cycle=24.0)], point=[None, "a", None])
    assert (a.most, c.most) == (max(x) - min(x), 12.0)
    assert math.isclose(b.classes, 3 + 1 / 40.5)
    got = Query(df).nearest(1, [Feature("x")], (None,)).first()["distance"]
    assert math.isclose(got, max(x) - min(x))


def test_replace_and_common_subsequences(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for text, pattern, by, most, want in (("aba", "a", "aa", 2, "aabaa"), ("aaa", "a", "b", 2, "bba"), ("x1y22", "([0-9]+)", "<$1>", 1, "x<1>y22"), ("abc", "z", "q", 3, "abc"), ("ab", "a", "b", 0, "ab")):
        assert one(strings.replace(F.lit(text), pattern, by, most)) == want
    r = random.Random(1)
    for _ in range(100):
        a, b = ("".join(r.choices("abcé", k=r.randint(0, 9))) for _ in range(2))
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for j, y in enumerate(b):
                rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
        assert strings.lcs_length(a, b) == rows[-1][-1]
    assert one(strings.edit_distance(F.lit("kitten"), F.lit("sitting"))) == 5.0

"""Queries on small tables with known results."""

import math

import pytest

from simloom.operators.distance import Feature, generalized_distance
from simloom.operators.query import Query


@pytest.fixture(scope="module")
def stats5(spark):
    return Query(spark.createDataFrame([(f"E{i}", float(i), float(6 - i)) for i in range(1, 6)], "id string, a double, weight double"))


@pytest.fixture(scope="module")
def verts(spark):
    rows = [("vert0", 1, 0, 0), ("vert1", 1, 1, 0), ("vert2", 1, 1, 1), ("vert3", 1, 0, 1), ("vert4", 2, 0.5, 0.5), ("vert5", 2, 2, 1)]
    return Query(spark.createDataFrame([(i, *map(float, r)) for i, *r in rows], "id string, object double, x double, y double"))


XY = [Feature("x"), Feature("y")]


def one(df):
    return df.first()[0]


def test_sums_and_quantiles(stats5):
    assert one(stats5.sum("a")) == 15 and one(stats5.sum("a", "weight")) == 35
    assert one(stats5.quantile("a", 0.5)) == 3
    assert one(stats5.quantile("a", 0.25)) == 2
    assert one(stats5.quantile("a", 0.5, "weight")) == pytest.approx(2.142857142857143)
    assert one(stats5.quantile("a", 0.25, "weight")) == pytest.approx(1.2777777777777777)
    assert one(stats5.quantile("a", 1.5)) is None


def test_mode_and_masses(spark, stats5):
    six = Query(stats5.df.union(spark.createDataFrame([("E5_2", 5.0, 1.0)], stats5.df.schema)))
    assert one(six.mode("a")) == 5 and one(six.mode("a", "weight")) == 1
    assert dict(six.value_masses("a").collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    assert dict(six.value_masses("a", "weight").collect()) == {1: 5, 2: 4, 3: 3, 4: 2, 5: 2}


@pytest.mark.parametrize(
    ("label", "options", "expected"),
    [
        ("a", {"p": 1}, 3), ("weight", {"p": 0}, 2.6051710846973517), ("weight", {"p": -1}, 2.18978102189781), ("a", {"p": 2}, 3.3166247903554),
        ("a", {"p": 1, "weight": "weight"}, 2.3333333333333335), ("weight", {"p": 0, "weight": "weight"}, 3.381434008029686),
        ("a", {"p": 1, "center": 3, "moment": True, "absolute": True}, 1.2), ("a", {"p": 2, "center": 3, "moment": True}, 2),
        ("a", {"p": 3, "center": 3, "moment": True}, 0), ("a", {"p": 4, "center": 3, "moment": True}, 6.8),
    ],
)
def test_generalized_mean(stats5, label, options, expected):
    assert one(stats5.generalized_mean(label, **options)) == pytest.approx(expected, abs=1e-9)


def test_gaps(spark):
    q = Query(spark.createDataFrame([(str(i), x) for i, x in enumerate([0.1, 1.0, 2.0, 3.0, 4.0, 5.0, 5.5, 5.5])], "id string, a double"))
    assert one(q.min_difference("a")) == pytest.approx(0.5)
    assert one(q.min_difference("a", include_zero=True)) == 0
    assert one(q.min_difference("a", cycle=5.5)) == pytest.approx(0.1)
    assert one(q.max_difference("a")) == 1
    assert one(q.max_difference("a", cycle=7.5)) == pytest.approx(2.1)
    single = Query(q.df.limit(1))
    assert one(single.min_difference("a")) is None and one(single.min_difference("a", cycle=2.0)) == math.inf


def test_presence(spark):
    rows = [(f"E{i}", float(i), None, None, ["a"]) for i in range(1, 6)]
    rows += [("E5q", 5.0, "a", None, ["a", "q"]), ("E6", 6.0, "q", None, ["a", "q"]), ("Er", None, None, "r", ["r"])]
    q = Query(spark.createDataFrame(rows, "id string, a double, q string, r string, __present array<string>"))

    def ids(x):
        return sorted(r[0] for r in x.ids().collect())

    assert ids(q.among("a", [1.0, 5.0])) == ["E1", "E5", "E5q"]
    assert ids(q.exists("a").among("q", ["a"])) == ["E5q"]
    assert ids(q.not_among("a", [1.0, 5.0])) == ["E2", "E3", "E4", "E6"]
    assert ids(q.exists("a").not_among("q", ["a"])) == ["E6"]
    assert ids(q.max("a")) == ["E6"] and ids(q.max("q", 1, False)) == ["E6"] and ids(q.min("q", 1, False)) == ["E5q"]
    assert ids(q.min("a", 2)) == ["E1", "E2"]
    assert ids(q.not_exists("q").exists("a")) == ["E1", "E2", "E3", "E4", "E5"]
    assert ids(q.equals("a", 5.0)) == ["E5", "E5q"] and ids(q.equals("a", "5")) == []
    assert ids(q.exists("!e")) == []
    assert ids(q.select(3)) == ["E1", "E2", "E3"] and ids(q.select(3, 1)) == ["E2", "E3", "E4"]
    assert ids(q.in_ids(["E1", "zz"])) == ["E1"] and len(ids(q.not_in_ids(["E1"]))) == 7


def test_seeded_selection(spark, stats5):
    parts = [sorted(r[0] for r in stats5.select(2, o, seed=3).ids().collect()) for o in (0, 2, 4)]
    assert sorted(sum(parts, [])) == ["E1", "E2", "E3", "E4", "E5"]
    drawn = [r[0] for r in stats5.sample(4000, "weight", seed=1).ids().collect()]
    assert len(drawn) == 4000
    assert drawn.count("E1") / 4000 == pytest.approx(5 / 15, abs=0.04)


def test_ordered(spark):
    q = Query(spark.createDataFrame([(f"E{i}", float(i), c) for i, c in enumerate("abcde", 1)], "id string, a double, b string"))
    assert [r[0] for r in q.at_most("a", 3).at_most("b", "c").ids().collect()] == ["E1", "E2", "E3"]
    assert [r[0] for r in q.at_least("a", 3).at_least("b", "c").ids().collect()] == ["E3", "E4", "E5"]
    n = Query(spark.createDataFrame([("1", "a2"), ("2", "a10"), ("3", "a 1")], "id string, s string"))
    assert sorted(r[0] for r in n.between("s", "a1", "a9").ids().collect()) == ["1", "3"]


def test_search(verts):
    near = verts.nearest(3, XY, (1.0, 2.0), p=2).collect()
    assert [(r[0], pytest.approx(r[1])) for r in near] == [("vert2", 1), ("vert3", math.sqrt(2)), ("vert5", math.sqrt(2))]
    assert sorted(r[0] for r in verts.within(1.5, XY, (1.0, 2.0), p=2).collect()) == ["vert2", "vert3", "vert5"]
    assert [r[0] for r in verts.nearest([0.2, 4], XY, (1.0, 2.0), p=2).collect()] == ["vert2", "vert3", "vert5", "vert4"]


def test_contributions(spark, verts):
    spot = spark.createDataFrame([(0, 1.0, 2.0)], "position int, x double, y double")
    assert verts.position_contributions(spot, 2, XY, p=2, exponent=-1).first()[1] == pytest.approx(1.17157287525381)
    got = dict(verts.distance_contributions(2, XY, p=2, exponent=-1).collect())
    assert got == pytest.approx({"vert0": 0.8284271247461902, "vert1": 0.8284271247461902, "vert2": 0.8284271247461902, "vert3": 0.8284271247461902, "vert4": 0.7071067811865476, "vert5": 1.17157287525381})


def test_divergence(verts):
    got = dict(verts.kl_divergences(2, XY, p=2, exponent=-1).collect())
    want = [0.00018681393615961172, 0.0003526679446349979, 0.005341750456218763, 0.00018681393615961172, 0.006401917906003654, 0.010670757326457676]
    assert got == pytest.approx({f"vert{i}": x for i, x in enumerate(want)}, rel=1e-6)
    got = dict(verts.convictions(2, XY, p=2, exponent=-1).collect())
    want = [20.64507068846579, 10.936029135274522, 0.7220080663101216, 20.64507068846579, 0.6024424202611007, 0.361435163373361]
    assert got == pytest.approx({f"vert{i}": x for i, x in enumerate(want)}, rel=1e-6)
    got = dict(verts.convictions(2, XY, p=2, exponent=-1, ids=["vert0", "vert1", "vert2"]).collect())
    assert got == pytest.approx({"vert0": 10.493921488434916, "vert1": 5.558800590831786, "vert2": 0.3669978212333347}, rel=1e-6)
    assert one(verts.group_kl(["vert4", "vert5"], 2, XY, p=2, exponent=-1)) == pytest.approx(0.01228960638554566, rel=1e-6)


def test_box(spark):
    q = Query(spark.createDataFrame([("vert0", 2.0, 0.0, 0.0), ("vert1", 1.0, 0.0, 1.0), ("vert2", 1.0, 1.0, 0.0), ("vert3", 1.0, 2.0, 1.0)], "id string, weight double, x double, y double"))
    assert dict(q.distance_contributions(1, XY, p=2, exponent=-1).collect()) == pytest.approx({"vert0": 1, "vert1": 1, "vert2": 1, "vert3": math.sqrt(2)})
    assert dict(q.distance_contributions(1, XY, p=2, exponent=-1, weight="weight").collect()) == pytest.approx({"vert0": 2, "vert1": 1, "vert2": 1, "vert3": math.sqrt(2)})
    got = dict(q.kl_divergences(1, XY, p=2, exponent=-1, removal=True).collect())
    assert got == pytest.approx({"vert0": 0.0125, "vert1": 0.0015, "vert2": 0.01294, "vert3": 0.0125}, rel=0.03)
    three = [Feature("x", deviation=0.25), Feature("y", deviation=0.25)]
    got = dict(q.distance_contributions(2, three, p=3, exponent="surprisal_to_prob", surprisal=True).collect())
    assert got == pytest.approx({"vert0": 2.035, "vert1": 2.284, "vert2": 2.284, "vert3": 3.638}, rel=2e-3)


def test_nulls(spark):
    q = Query(spark.createDataFrame([("a1", 10.0, None), ("a2", 11.0, 2.0), ("a3", None, 1.0)], "id string, A double, B double"))
    both = [Feature("A", most=1.0), Feature("B", most=1.0)]
    got = dict(q.nearest(3, both, (9.0, 2.0), p=2).collect())
    assert got == pytest.approx({"a1": math.sqrt(2), "a2": 2, "a3": math.sqrt(2)})


def test_clusters(spark):
    rows = [(0, 0), (0, 1), (1, 0), (10, 10), (10, 11), (11, 10)]
    q = Query(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id int, x double, y double"))
    assert [r[1] for r in sorted(q.clusters(2, 2.0, XY, p=2).collect())] == [1, 1, 1, 2, 2, 2]


def distance(spark, a, b, features, **options):
    from pyspark.sql import functions as F

    return spark.range(1).select(generalized_distance(features, [F.lit(x) for x in a], [F.lit(x) for x in b], **options)).first()[0]


def test_distances(spark):
    two = [Feature("x"), Feature("y")]
    assert distance(spark, (0.0, 0.0), (3.0, 4.0), two, p=2) == 5
    assert distance(spark, (0.0, 0.0), (3.0, 4.0), two, p=-math.inf) == 3
    half = [Feature("x", weight=0.5), Feature("y", weight=0.5)]
    assert distance(spark, (0.0, 0.0), (3.0, 4.0), half, p=2) == pytest.approx(3.5355339059327378)
    assert distance(spark, (0.0, 0.0), (3.0, 4.0), half, p=1) == pytest.approx(3.5)
    assert distance(spark, (0.0, 0.0), (3.0, 4.0), half, p=0) == pytest.approx(3.4641016151377544)
    noisy = [Feature("x", deviation=0.5, weight=1.0), Feature("y", deviation=0.5, weight=1.0)]
    assert distance(spark, (1.0, 1.0), (2.0, 2.0), noisy, surprisal=True) == pytest.approx(1.6766764161830636)
    mixed = [Feature(n, kind, deviation=s, weight=1 / s, classes=c) for n, kind, s, c in zip("abcdef", ("nominal", "nominal", "nominal", "continuous", "nominal", "continuous"), (0.4, 0.1, 0.2, 30, 0.3, 0.05), (2, 100, 2, None, 2, None), strict=True)]
    assert distance(spark, (1, 2, 1, 100.0, 1, 50.0), (1, 1, 1, 120.0, 1, 50.1), mixed, p=1) > 0


def test_text_distance(spark):
    assert distance(spark, ("s12", 1.0), ("s21", 2.0), [Feature("s", "string"), Feature("x")]) == 3

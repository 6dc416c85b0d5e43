"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from simloom.functions import formats, trees
from simloom.operators import clusters
from simloom.plans import catalog, scalars
from simloom.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False))


OWN = catalog.queries() | scalars.queries()
SQL = catalog.oracle_sql() | scalars.oracle_sql()


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    got = OWN[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got) or name.startswith("q_nearest")


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_forest_and_noise():
    edges = [(1.0, 0, 1), (1.0, 1, 2), (9.0, 2, 3), (1.0, 3, 4), (1.0, 4, 5), (50.0, 5, 6)]
    assert len(clusters.spanning_forest([*edges, (2.0, 0, 2)])) == 6
    assert clusters.hierarchy_clusters(7, edges, [1.0] * 7, 2.0) == [1, 1, 1, 2, 2, 2, 0]


def test_tied_merges():
    """Pairs at distance 1, joined at 2: clusters and their parts come about at one density."""
    edges = [(1.0, 0, 1), (1.0, 2, 3), (1.0, 4, 5), (1.0, 6, 7), (2.0, 1, 2), (2.0, 3, 4), (2.0, 5, 6)]
    assert clusters.hierarchy_clusters(8, edges, [1.0] * 8, 2.0) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert clusters.hierarchy_clusters(4, [(0.0, 0, 1), (0.0, 1, 2), (0.0, 2, 3)], [1.0] * 4, 2.0) in ([0] * 4, [1, 1, 2, 2])


def test_trees():
    a, b = {"x": [1, 2, 3], "y": 1}, {"x": [1, 3], "z": 2}
    assert trees.size(a) == 6 and trees.common(a, b) == 4 and trees.distance(a, b) == 3
    assert trees.patch(a, trees.difference(a, b)) == b
    assert trees.union([1, 2], [2, 3]) == [1, 2, 3] and trees.intersect([1, 2], [2, 3]) == [2]


def test_yaml():
    x = {"a": 1, "b": [1, {"c": None, "d": "x: y"}], "e": {"f": [True, "plain"]}, "g": []}
    assert files.parse_yaml(formats.yaml_text(x)) == x


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "a,b"), (2.0, 'say "x"'), (None, "plain")], "n double, s string")
    for kind in ("csv", "json", "parquet"):
        files.store_table(df, f"{tmp_path}/{kind}", kind)
        back = files.load_table(spark, f"{tmp_path}/{kind}", kind, **({"whole": False} if kind == "json" else {}))
        assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, (tuple(r) for r in df.collect())))
    files.store_table(df.limit(1).coalesce(1), f"{tmp_path}/yaml", "yaml")
    assert tuple(files.load_table(spark, f"{tmp_path}/yaml", "yaml", schema="n double, s string").first()) == (1.5, "a,b")


def test_change_log(spark, tmp_path):
    from simloom.streaming import changes

    log = spark.createDataFrame([(1, "create", 1, "a"), (2, "create", 2, "b"), (3, "assign", 1, "c"), (4, "destroy", 2, None)], "seq int, op string, id int, v string")
    assert [tuple(r) for r in changes.latest(log).collect()] == [(1, "c")]
    log.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    changes.follow(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/table/0").select("id", "op").collect()) == [(1, "assign"), (2, "destroy")]

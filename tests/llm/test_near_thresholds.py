"""Near copies at thresholds other than op10's 85 percent."""

import pytest

pytest.importorskip("simloom.llm")

import corpus_pipeline
from simloom.llm import near_dedup


def pairs(spark, shared, n):
    """n pairs of texts of 100 shingles each that share that many: ids 2 k and 2 k + 1."""
    rows = []
    for k in range(n):
        words = [f"w{k}x{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: shared + 4], *(f"v{k}x{i}" for i in range(100 - shared))]))]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_low_threshold(spark):
    for percent, shared in ((60, 75), (80, 89)):  # 75 of 125, 89 of 111
        got = near_dedup.near_duplicates(pairs(spark, shared, 40), percent=percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(80)}, percent
        below = near_dedup.near_duplicates(pairs(spark, shared - 1, 40), percent=percent)
        assert below.filter("kept").count() == 80, percent


def test_pipeline_takes_pairs_from_080(spark):
    """A similarity of 0.80 is a near copy to the stage, 0.79 isn't; op10's contract stays at 0.85."""
    docs = pairs(spark, 89, 10)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == list(range(0, 20, 2))
    assert corpus_pipeline.near(spark, pairs(spark, 88, 10), "").count() == 20
    assert near_dedup.near_duplicates(docs).filter("kept").count() == 20


def test_signature_bounds():
    """Pairs just at the threshold aren't ruled out by signatures, at any threshold."""
    for percent in (20, 50, 60, 70, 80, 85, 95, 100):
        least = near_dedup.least_agreeing(percent, 64)
        assert sum(near_dedup.agreement(percent, 64)[:least]) <= 1e-5
        assert (1 - percent / 100) ** near_dedup.fewest_trees(percent) <= 1e-6
    assert (near_dedup.least_agreeing(85, 64), near_dedup.fewest_trees(85)) == (41, 8)  # as they were for op10


def test_hot_nodes_keep_the_recall():
    """The stated recall holds for pairs whose nodes all branch, to any depth; before, eight trees of three by three missed 5e-4."""
    assert near_dedup.missed(85, 64, 8, 3, 3, 4) > 1e-4
    for percent in (60, 80, 85, 95):
        for depth in (0, 1, 2, 4):
            trees, children, tokens = near_dedup.branching(percent, 64, depth)
            assert trees >= near_dedup.fewest_trees(percent)
            assert not children or near_dedup.missed(percent, 64, trees, children, tokens, depth) <= 1e-5
    assert near_dedup.branching(85, 64, 4)[1] and near_dedup.branching(80, 64, 4)[1]


def test_large_nodes_without_branching(spark):
    """Where no branching keeps the recall, large nodes are compared in blocks."""
    assert near_dedup.branching(30, 64, 4)[1] == 0
    words = [f"w{i}" for i in range(54)]  # each pair has 50 of 150
    docs = spark.createDataFrame([(k, " ".join([*words, *(f"v{k}x{i}" for i in range(50))])) for k in range(12)], "doc_id bigint, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs, percent=30, small=2).collect()} == {0}

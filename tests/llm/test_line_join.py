"""Rows that the join of line dedup makes, and the size of its largest table."""

import random

from simloom.llm import common, line_dedup


def _similar(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split(), y.split()))
    return 100 * len(a & b) >= 80 * len(a | b)


def test_pairs_meet_at_few_of_their_tokens(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(40):  # near copies that resemble some others, but seldom the first
        own = list(base)
        for at in rng.sample(range(8), 5):
            own[at * 25] = f"x{at}_{rng.randrange(6)}"
        texts.append(" ".join(own))
    made, kind = [], type(spark.range(1))
    distinct = kind.distinct

    def counted(df):
        if [c[:2] for c in df.columns] == ["a_", "b_"]:
            made.append((df.count(), distinct(df).count()))
        return distinct(df)

    monkeypatch.setattr(kind, "distinct", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r["doc_id"] for r in line_dedup.line_dedup(docs).collect() if r["n_removed"]}
    assert gone == {j for j in range(len(texts)) if any(_similar(texts[i], texts[j]) for i in range(j))}
    rows, pairs = made[-1]  # of those that the earliest ones leave open
    assert pairs > 10 and rows <= 3 * pairs


def test_packed_tables_take_less_space(spark):
    words = spark.range(20_000).selectExpr("concat_ws(' ', id % 97, 'word', id % 89, 'another', id * 7 % 1001) AS line")

    def size(df):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        files = [hadoop(f) for f in df.inputFiles()]
        return sum(f.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(f).getLen() for f in files)

    plain, packed = common.settle(words, "plain"), common.settle_packed(words, "packed")
    assert size(packed) < 0.8 * size(plain)
    assert packed.exceptAll(words).count() == 0 and packed.count() == 20_000

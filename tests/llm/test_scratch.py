"""What operators leave behind while they run: shuffle files; and the tokens of lines."""

import random
import time
from functools import reduce
from operator import xor

from pyspark.sql import functions as F

import corpus_pipeline
from simloom.llm import common, line_dedup, near_dedup


def test_settled_tables_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(common, "COLLECT_S", 0.0, raising=False)
    files = spark._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return {x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()) if x.getName().startswith("shuffle_")}

    before = shuffled()
    for k in range(3):
        assert common.settle(spark.range(1000).groupBy((F.col("id") % 97 + k).alias("g")).count(), "scratch-test").count() == 97
    common.settle(spark.range(1), "scratch-test")
    for _ in range(100):
        if len(shuffled() - before) <= 8:  # of the count that came last
            return
        time.sleep(0.1)
    raise AssertionError(f"{len(shuffled() - before)} files stay")


def test_tokens_are_the_distinct_shingles(spark):
    lines = ["a", "a b", "a b c d", "a b c d e", "a b c d e f", "a b a b a b a b a", "b c d e f g h", "x a b c d e f y"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    ranks = common.number_array([(i % 3) << line_dedup.HASH_BITS for i in range(line_dedup.CELLS)], "bigint")
    for k in (1, 2, 3, 5, 6, 7):
        got = {r["line"]: r["tokens"] for r in line_dedup._with_tokens(frame, k, ranks).collect()}
        known = {}
        for x in lines:
            w = x.split(" ")
            want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {("whole", *w)}
            assert got[x] == sorted(got[x]) and len(got[x]) == len(want)
            known[x] = want
        for x in lines:
            for y in lines:
                assert len(set(got[x]) & set(got[y])) == len(known[x] & known[y])


def test_each_stage_of_the_pipeline_starts_on_rested_executors(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "rest_executors", lambda s: calls.append("rest"), raising=False)
    docs = spark.createDataFrame([(1, "some words of plain text stand here", "en", "web", 35)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: spark.createDataFrame([(1, "no such words")], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES:
        calls.clear()
        stage(spark, docs, "")
        assert len(calls) == (2 if name == "byte_bpe" else 1), name


def test_executors_at_rest_have_collected(spark):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans)

    before = collections()
    common.rest_executors(spark)
    assert collections() > before


def test_parities_differ_in_as_many_cells_as_tokens_differ_at_most(spark):
    rng = random.Random(3)
    sets = [[rng.getrandbits(63) - (1 << 62) for _ in range(rng.randrange(0, 90))] for _ in range(40)]
    sets += [x[: k % 9] + x[k % 9 + 1 :] for k, x in enumerate(sets)]
    rows = spark.createDataFrame(list(enumerate(sets)), "k int, tokens array<bigint>")
    odd = {r["k"]: r["odd"] & (1 << 64) - 1 for r in rows.select("k", line_dedup._parities("tokens").alias("odd")).collect()}
    for k, x in enumerate(sets):
        assert odd[k] == reduce(xor, (1 << (t & 63) for t in x), 0)
        for j, y in enumerate(sets):
            assert (odd[k] ^ odd[j]).bit_count() <= len(set(x) ^ set(y))


def test_lines_that_share_a_passage_only_are_no_pairs(spark, monkeypatch):
    pairs, settle = [], line_dedup.settle

    def counted(df, name):
        out = settle(df, name)
        if name == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "settle", counted)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(12))  # all words are about as frequent
    texts = [passage + " " + " ".join(f"w{rng.randrange(30)}" for _ in range(30)) for _ in range(60)]
    texts += [texts[0] + " end", "z" + texts[1][2:]]  # 38 of 39 shingles; 37 of 39
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k for k, n in got.items() if n} == {60, 61}
    assert 2 <= pairs[0] <= 10


def test_members_get_their_signatures_before_they_branch(spark, monkeypatch):
    plans, settle = [], near_dedup.settle

    def seen(df, name):
        if name == "near-nodes-2":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
        return settle(df, name)

    monkeypatch.setattr(near_dedup, "settle", seen)
    common_part = " ".join(f"c{i}" for i in range(60))
    docs = spark.createDataFrame([(k, common_part + " " + " ".join(f"w{k}x{i}" for i in range(25))) for k in range(30)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs, percent=80, small=4).filter("kept").count() == 30
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    for plan in plans:
        for k, line in enumerate(plan):
            if "Join Inner, (cid" in line:
                below = []
                for x in plan[k + 1 :]:
                    if deep(x) <= deep(line):
                        break
                    below.append(x)
                assert not any("Generate explode" in x for x in below)
    assert plans


def test_wide_parities_differ_in_as_many_cells_as_tokens_differ_at_most(spark):
    rng = random.Random(5)
    sets = [[rng.getrandbits(63) - (1 << 62) for _ in range(rng.randrange(line_dedup.WIDE + 1, 260))] for _ in range(20)]
    sets += [x[: 3 * k] + x[4 * k :] + [k] for k, x in enumerate(sets)]
    sets = [x for x in sets if len(x) > line_dedup.WIDE]
    rows = spark.createDataFrame(list(enumerate(sets)), "k int, tokens array<bigint>").select("k", line_dedup._odd().alias("odd"))
    pairs = rows.alias("a").crossJoin(rows.alias("b")).select("a.k", F.col("b.k").alias("j"), line_dedup._differing(F.col("a.odd"), F.col("b.odd")).alias("d"))
    for r in pairs.collect():
        cells = reduce(xor, (1 << (t & 255) for t in sets[r["k"]] + sets[r["j"]]))
        assert r["d"] == cells.bit_count() <= len(set(sets[r["k"]]) ^ set(sets[r["j"]]))


def _pairs_of(spark, monkeypatch, texts):
    """Which texts lose a line, and the pairs of lines that were verified, by table."""
    pairs, settle = {}, line_dedup.settle

    def counted(df, name):
        out = settle(df, name)
        if name in ("line-pairs", "line-rest"):
            pairs[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "settle", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in line_dedup.line_dedup(docs).collect() if r["n_removed"]}, pairs


def test_near_copies_of_one_line_are_not_joined_pair_by_pair(spark, monkeypatch):
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)] + [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(60)]
    gone, pairs = _pairs_of(spark, monkeypatch, texts)
    assert gone == set(range(1, 61))
    assert sum(pairs.values()) <= 10 * len(texts)  # of 1,830


def test_long_lines_that_share_half_are_no_pairs(spark, monkeypatch):
    rng = random.Random(6)
    half = " ".join(f"p{i}" for i in range(120))
    texts = [half + " " + " ".join(f"v{rng.randrange(60)}" for _ in range(70)) for _ in range(40)]
    texts.append(texts[0] + " end")
    gone, pairs = _pairs_of(spark, monkeypatch, texts)
    assert gone == {40}
    assert sum(pairs.values()) <= 20


def test_a_line_that_only_a_removed_one_resembles_goes(spark, monkeypatch):
    words = [f"w{i}" for i in range(104)]
    chain = [list(words)]
    for k in (10, 50, 90):  # each step changes more; the last one resembles its neighbour, not the first
        chain.append([f"x{k}_{i}" if k <= i < k + 6 else w for i, w in enumerate(chain[-1])])
    sets = [{tuple(c[i : i + 5]) for i in range(len(c) - 4)} for c in chain]
    like = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {j for j in range(len(sets)) if any(like(sets[i], sets[j]) for i in range(j))}
    assert want == {1, 2, 3} and not like(sets[0], sets[2]) and not like(sets[0], sets[3])
    assert _pairs_of(spark, monkeypatch, [" ".join(c) for c in chain])[0] == want

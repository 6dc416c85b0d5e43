"""The registered queries and the pipeline on a small corpus, against brute force."""

import hashlib
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("simloom.llm")

import corpus_pipeline
from simloom.llm import byte_bpe, near_dedup, queries, secrets


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    en, de = ["the", "house", "and", "with", "which", "river", "stone"], ["der", "und", "nicht", "straße", "welche", "fluss", "stein"]
    out = [" ".join(r.choices(words, k=r.choice([5, 40, 90]))) for _ in range(20) for words in (en, de)]
    long = " ".join(r.choices(en, k=100)).split(" ")
    near = [" ".join(long), " ".join([*long[:99], "river2"]), " ".join(["stone2", *long[1:]])]
    item = " ".join(r.choices(de, k=12))
    out += [out[3], out[3].replace(" ", "  "), *near, f"{out[4]} {item} {out[6]}", None, "", "123 ...", "token='abcdefabcdef0123' the house"]
    return out, item


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, None if t is None else "de" if re.search("der|und|nicht", t) else "en", "src", len(t or "")) for i, t in enumerate(texts[0])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, texts[1])], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_digests(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_secret_scan"](spark, sf_dir).collect()}
    words = secrets.automaton()
    for i, t in enumerate(texts[0]):
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.scan(t or "", words))
        assert got[i]["spans"] == spans and got[i]["base_sha256"] == sha(spans)
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.default_vocabulary()
    right = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for r in queries.QUERIES["op3_byte_bpe"](spark, sf_dir).collect():
        t = texts[0][r["doc_id"]] or ""
        ids = right.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t))
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    other, start = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in sorted(queries.QUERIES["op8_token_files"](spark, sf_dir).collect()):
        ids = [*other.encode(texts[0][r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_pipeline(spark, sf_dir, texts):
    kept = [(i, t) for i, t in enumerate(texts[0]) if t and re.search(r"[^\W\d_]", t)]
    seen, exact = set(), []
    for i, t in kept:
        key = re.sub("[\x20\x09-\x0d]+", " ", t)
        if key not in seen:
            exact.append((i, t))
            seen.add(key)
    near, sets = [], []
    for i, t in exact:
        own = set(near_dedup.shingles(t.encode()).tolist())
        if not any(100 * len(own & s) >= 80 * len(own | s) for s in sets):
            near.append((i, t))
        sets.append(own)  # the copies here form pairs and stars of the first one
    item = texts[1].split(" ")
    windows = [" ".join(item[k : k + 10]) for k in range(3)]
    clean = {i: t for i, t in near if not any(w in t for w in windows)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(clean)
    assert all(r["decoded_sha256"] == sha(clean[i]) and r["n_tokens"] == len(r["ids"]) for i, r in got.items())


def test_stages_take_awkward_rows(spark, sf_dir, texts):
    """Null ids, ids of several texts, repeated rows, clashing columns and no rows: rows are judged by their own text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    english = texts[0][2]
    odd = [(None, None), (None, texts[0][3]), (None, f"{english} {texts[1]}"), (0, "123"), (0, english + " stone"), (0, f"{english} {texts[1]} the")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    rows = docs.union(docs.filter("doc_id in (0, 2)")).union(more).withColumn("id", F.lit("x")).withColumn("kept", F.lit(True)).withColumn("spans", F.lit(1))
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, rows.filter("false"), sf_dir).columns == rows.columns, name
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == rows.columns, name
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert not [t for _, t in left if t is None or t == "123" or texts[1] in t]
    assert len([1 for i, t in left if t == texts[0][0]]) in (0, 2)  # alike in id and text
    assert [i for i, t in left if t == texts[0][3]] == [None]
    assert not any(t == english + " stone" for _, t in left) or not any(t == english for _, t in left)
    last = corpus_pipeline.byte_bpe(spark, rows, sf_dir)
    assert last.count() == rows.count() and {r["n_tokens"] for r in last.filter("doc_id is null").collect()} >= {0}

"""Suffix dedup of texts that are cut into parts, and of groups that are split."""

import random
from collections import Counter

import pytest

pytest.importorskip("simloom.llm")

from simloom.llm import suffix_dedup


def brute(texts):
    seen = Counter(b[s : s + 200] for b in texts.values() for s in range(len(b) - 199))
    out = {}
    for i, b in texts.items():
        hit = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                hit[s : s + 200] = b"\1" * 200
        out[i] = bytes(c for c, h in zip(b, hit, strict=True) if not h)
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i, b.decode()) for i, b in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute(texts)


def test_long_texts_lose_repeats_only(spark, monkeypatch):
    """A text far above the cut: its own text is unique, so nothing but a copied passage goes, wherever the cuts lie."""
    monkeypatch.setattr(suffix_dedup, "_AT_ONCE", 1000)
    r = random.Random(5)
    unique = bytes(r.choices(b"0123456789abcdef", k=13_000))
    check(spark, {0: unique})
    passage = bytes(r.choices(b"0123456789abcdef", k=700))
    check(spark, {0: unique, 1: unique[:6900] + passage + unique[:50] + passage + unique[9000:9150], 2: b"x" * 3500})


@pytest.mark.parametrize("most", [2, 3, 2000])
def test_many_surroundings_of_one_passage(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    r = random.Random(6)
    passage = bytes(r.choices(b"abcdefgh ", k=230))
    texts = {i: bytes(r.choices(b"ab", k=r.randint(0, 40))) + passage[r.randint(0, 12) : 230 - r.randint(0, 12)] + bytes(r.choices(b"ab", k=r.randint(0, 40))) for i in range(40)}
    check(spark, texts)

"""The pipeline's language stage: the calibrated score decides, and an unlabelled table keeps its texts."""

import random

import pytest

pytest.importorskip("simloom.llm")

import corpus_pipeline


def test_language_stage(spark):
    r = random.Random(3)
    words = {"en": ["the", "and", "with", "house", "which"], "de": ["der", "und", "nicht", "straße", "welche"], "fr": ["le", "et", "avec", "maison", "quelle"]}
    rows = [(i, " ".join(r.choices(words[k], k=20)), k) for i, k in enumerate(r.choices(list(words), k=150))]
    odd = [(900, "привет мир как твои дела сегодня", None), (901, "日本語の文章です", None)]
    none = [(910, None, None), (911, "", None), (912, "123 ...", None)]
    docs = spark.createDataFrame([*rows, *odd, *none], "doc_id bigint, text string, lang string")

    def stays(df):
        return sorted(x["doc_id"] for x in corpus_pipeline.language_id(spark, df, "").collect())

    assert stays(docs) == list(range(150))
    assert stays(docs.selectExpr("doc_id", "text", "cast(null as string) lang")) == [*range(150), 900, 901]

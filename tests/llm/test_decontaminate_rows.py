"""Several benchmark blocks give each input row its own result."""

import pytest

pytest.importorskip("simloom.llm")

from simloom.llm import decontaminate


def test_blocks_keep_awkward_rows(spark, monkeypatch):
    """Null and repeated ids, with texts that differ under one id: the same rows from one block as from many."""
    texts = [" ".join(f"w{k}x{i}" for i in range(14)) for k in range(12)]
    rows = [(i, f"before {t} after") for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, texts[1] + " more"), (None, None), (None, texts[0]), (3, texts[4]), (3, texts[3]), (3, "clean"), (5, ""), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")

    def found():
        return sorted(map(str, decontaminate.decontaminate(docs, benchmark).collect()))

    whole = found()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert len(whole) == len(rows) and found() == whole

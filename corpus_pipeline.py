"""The corpus pipeline: STAGES applied to documents one after another.

Each stage takes (spark, docs, sf_dir) and returns documents that stay, with the columns of documents; the last one
returns their token ids. Every stage's rows are written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.byte_bpe import decode_ids, default_vocabulary, encode_documents, load_ranks, piece_list
from simloom.llm.common import rest_executors, settle, table, without_ids
from simloom.llm.decontaminate import decontaminate
from simloom.llm.exact_dedup import exact_dedup
from simloom.llm.language_id import UNDETERMINED, fit_language_model, held_out, identify
from simloom.llm.near_dedup import near_duplicates


#: The column that tells rows apart within a stage.
KEY = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of the id and a hash of the text: ids may be null, or name different texts."""
    return docs.withColumn(KEY, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark")))


def _without(docs: DataFrame, found: DataFrame, goes: Column) -> DataFrame:
    """docs without the rows whose keys `goes` holds for. Those are few beside the documents, which aren't shuffled."""
    gone = settle(found.filter(goes).select(F.col(KEY).alias("id")).distinct(), "pipeline-gone")
    return without_ids(_keyed(docs), KEY, gone).drop(KEY)


#: The calibrated score from which a language counts as told. Letters of no learnt language score about even between
#: labels; of the 1,000 documents of sf0.01 with their four languages, none has less than 0.7.
LEAST_SCORE = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those go whose calibrated score is below LEAST_SCORE, or that are null or
    have no letter. Where there is no label to learn from, only the latter go. Each row is judged by its own text."""
    model = fit_language_model(docs.filter(~held_out()))
    if not model.labels:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = identify(_keyed(docs), model, id_col=KEY)
    return _without(docs, found, (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < LEAST_SCORE))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the smallest id (null before all). Null texts are empty.
    Rows that are alike in id and text can't be told apart and share their fate."""
    keyed = _keyed(docs)
    return _without(docs, exact_dedup(keyed, id_col=KEY), ~F.col("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id (null before all): shingles of five words,
    a similarity of 0.8 or more. Texts without words are copies of nothing."""
    return _without(docs, near_duplicates(_keyed(docs), percent=80, words=5, id_col=KEY), ~F.col("kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Each row is judged by its own text; without benchmark all stay."""
    found = decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark"), id_col=KEY)
    return _without(docs, found, F.size("spans") > 0)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and the digest of the text that they decode to. Null text has no ids."""
    path, pattern = default_vocabulary()
    found = encode_documents(docs, path, pattern)
    rest_executors(spark)  # the words and the book are made; what is left runs with two Python workers a task
    decoded = F.sha2(decode_ids(F.col("ids"), piece_list(load_ranks(path))), 256)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", decoded.alias("decoded_sha256"))


def _rested(stage):
    """The stage, on executors that hold no garbage of those before it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest_executors(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _rested(language_id)),
    ("exact_dedup", _rested(exact)),
    ("near_dedup", _rested(near)),
    ("decontaminate", _rested(decontaminated)),
    ("byte_bpe", _rested(byte_bpe)),
]

#: Language scores, near-duplicate search and merges can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

from pyspark.sql import functions as F

from simloom.llm import byte_bpe


def test_rank_arrays_stay_out_of_plans(spark):
    ranks = byte_bpe.load_ranks(byte_bpe.default_vocabulary()[0])
    mapped = byte_bpe.rank_map(ranks)
    words = spark.createDataFrame([("hello",)], "w string").select(F.array(byte_bpe.byte_ids(F.col("w"), mapped.of_byte)).alias("w"))
    plan = words.select(byte_bpe.fold_merges(F.col("w"), mapped).alias("ids"))
    assert len(plan._jdf.queryExecution().toString()) < 200_000

"""A log of changes to a table, applied in order: create, assign and destroy rows by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, id_col: str = "id", order_col: str = "seq") -> DataFrame:
    """The last entry of each id; ids whose last entry is `destroy` are gone. Entries have a column op."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order_col)))
    return log.withColumn("_r", rank).filter("_r = 1 and op <> 'destroy'").drop("_r", "op", order_col)


def follow(log: DataFrame, path: str, checkpoint: str, id_col: str = "id", order_col: str = "seq"):
    """Keeps the table at path/current up to date with a streamed log, a batch at a time; returns the running query."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parts = [batch]
        if number:
            parts.append(spark.read.parquet(f"{path}/{number - 1}"))
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order_col)))
        every.withColumn("_r", rank).filter("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{path}/{number}")

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

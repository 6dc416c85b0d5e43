"""Shared helpers of the corpus operators: reading tables, scratch tables and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a temporary one only where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("simloom.scratch.dir", None)
        if not root:
            if spark.sparkContext.master.split("[")[0] != "local":  # executors elsewhere don't see this machine's folders
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            root = "file://" + tempfile.mkdtemp(prefix="simloom-")
            spark.conf.set("simloom.scratch.dir", root)
            _forget_at_exit(spark, root)
    return root


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def forget() -> None:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass

    atexit.register(forget)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a scratch table; it goes when the application ends."""
    path = f"{scratch_root(spark)}/simloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _forget_at_exit(spark, path)
    return path


def settle(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared scratch folder and reads it again.

    Executors may be lost afterwards without losing the rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    _forget_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_packed(df: DataFrame, name: str) -> DataFrame:
    """settle for large tables that stay for long: Zstandard takes less space than Snappy, and a little more time."""
    return settle(df, name, "zstd")


#: Seconds between two collections of the driver's garbage, and when the last one was.
COLLECT_S = 2.0
_collected = [0.0]


def _forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over, which it does once the driver's JVM has collected its
    garbage; by itself that may be half an hour later. The JVM and Python give free memory back, too."""
    if time.monotonic() - _collected[0] >= COLLECT_S:
        collect_now(spark)


def collect_now(spark: SparkSession) -> None:
    """Collects the driver's garbage, whenever it was collected last."""
    release()
    spark._jvm.System.gc()
    _collected[0] = time.monotonic()


def rest_executors(spark: SparkSession) -> None:
    """Executors collect their garbage, so that their heaps shrink to what is in use: a heap that earlier work has let
    grow stays that large, beside the Python workers of what comes next. A task for each core reaches every executor
    that is idle; one that isn't reached only keeps its memory."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def number_array(values, kind: str) -> Column:
    """A literal array of numbers; kind is int or bigint.

    Spark keeps it as one block of bytes. A literal made by array() or from_json() is an object a number instead, which
    every task unpacks one by one and every plan's text spells out.
    """
    from pyspark.sql.classic.column import Column as Classic

    spark = SparkSession.active()
    jvm, wide = spark._jvm, kind == "bigint"
    raw = np.asarray(values).astype(">i8" if wide else ">i4")
    made = spark.sparkContext._gateway.new_array(jvm.long if wide else jvm.int, len(raw))
    buffer = jvm.java.nio.ByteBuffer.wrap(raw.tobytes())
    (buffer.asLongBuffer() if wide else buffer.asIntBuffer()).get(made)
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    packed = catalyst.UnsafeArrayData.fromPrimitiveArray(made)
    literal = catalyst.Literal(packed, jvm.org.apache.spark.sql.types.DataType.fromDDL(f"array<{kind}>"))
    return Classic(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def drop_settled(*tables: DataFrame) -> None:
    """Deletes tables that settle wrote, once nothing reads them any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, path)


def as_bytes(text: str | Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the id and the text bytes, under fixed names, so that no other column of docs can clash."""
    return docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("body"), *more)


#: Bits of one of Spark's bitmaps, and bitmaps that are broadcast at once: 512 of 4 KB.
BITMAP_BITS = 32768
BITMAPS = 512


def _bitmap(ids: DataFrame) -> DataFrame:
    """Ids (a column id) as a bitmap of a fixed size: (_b, _bits). False hits are possible, misses aren't."""
    at = F.pmod(F.xxhash64("id"), F.lit(BITMAPS * BITMAP_BITS))
    spots = ids.select(F.floor(at / BITMAP_BITS).cast("int").alias("_b"), (at % BITMAP_BITS).cast("bigint").alias("_at"))
    return spots.groupBy("_b").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def marked(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """rows with _hit: whether the id may be among ids. Only the bitmap is broadcast, 2 MB at most."""
    at = F.pmod(F.xxhash64(F.col(id_col)), F.lit(BITMAPS * BITMAP_BITS))
    bit = F.expr("shiftright(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10), _at % 8) & 1").cast("int") == 1
    spots = rows.withColumn("_b", F.floor(at / BITMAP_BITS).cast("int")).withColumn("_at", (at % BITMAP_BITS).cast("int"))
    return spots.join(F.broadcast(_bitmap(ids)), "_b", "left").withColumn("_hit", F.coalesce(bit, F.lit(False))).select(*rows.columns, "_hit")


def only_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids (a column id); the texts of others stay out of the shuffle."""
    near = marked(rows, id_col, ids).filter("_hit").drop("_hit")
    return near.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi").select(*rows.columns)


def without_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ids (a column id); only rows that the bitmap can't acquit are shuffled.

    Rows with a null id stay.
    """
    split = marked(rows, id_col, ids)
    unsure = split.filter("_hit").drop("_hit").join(ids.select(F.col("id").alias(id_col)), id_col, "left_anti")
    return split.filter("not _hit").drop("_hit").union(unsure.select(*rows.columns))


def release() -> None:
    """Gives memory that is free back to the system; the process may stay for other work, or idle beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such function
        pass


def trimmed(work):
    """A function of batches that gives memory back once the task has its last batch."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def slices(column: pa.Array, most_bytes: int = 8 << 20):
    """Cuts a binary column into ranges of rows that hold about most_bytes, one row at least."""
    start, held = 0, 0
    for i, x in enumerate(column):
        n = len(x.as_buffer()) if x.is_valid else 0
        if held and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(column):
        yield start, len(column)

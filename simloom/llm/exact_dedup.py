"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: A bitmap of Spark's bitmap functions has so many bits.
BITS = 32768


def normalised(text: Column) -> Column:
    """Every run of white space ``[\\x20\\x09-\\x0D]+`` becomes one space; null becomes empty.

    A lone space stays as it is, so only runs that change are rewritten.
    """
    run = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), run, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    bitmap_buckets: int = 256,
    all_fingerprints: bool = False,
) -> DataFrame:
    """Finds equal texts; of each group the row with the smallest id stays.

    Three passes narrow the rows down: lengths that occur once end there, then prefix hashes within a length,
    and only rows whose (length, prefix hash) occurs again have their whole text hashed (SHA-256), which decides.
    The survivors of the first two passes reach the scan as a bitmap of ``bitmap_buckets`` * 32768 bits, a fixed
    size; a false hit only costs a hash. Texts are never shuffled: ids, lengths and hashes are. Hot groups are
    pre-aggregated on the map side.

    Returns one row per input row: ``id_col``, keep_id, group_size, kept, fingerprint (binary SHA-256; null for
    rows that needed none unless ``all_fingerprints``). Null text equals empty text. Rows with a null id count in
    group_size and are kept only if the whole group has no id (keep_id is then null). Rows that share the smallest
    id of their group are all kept, as the id does not tell them apart. Other columns are ignored, so their names
    cannot clash. An empty table gives an empty result.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).select(
        "_id", "_t", F.octet_length("_t").alias("_len"), F.xxhash64(F.substring("_t", 1, prefix_chars)).alias("_pre")
    )
    keys = settle(rows.groupBy("_len", "_pre").agg(F.count("*").alias("_n")), "exact-keys")
    lengths = keys.groupBy("_len").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_len")
    again = keys.filter("_n > 1").join(lengths, "_len", "left_semi")
    bit = F.pmod(F.xxhash64("_len", "_pre"), F.lit(bitmap_buckets * BITS))
    marks = (
        again.select(F.floor(bit / BITS).cast("int").alias("_b"), (bit % BITS).cast("bigint").alias("_at"))
        .groupBy("_b")
        .agg(F.bitmap_construct_agg("_at").alias("_bits"))
    )
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    marked = F.coalesce(F.expr("shiftright(_y, _at % 8) & 1") == 1, F.lit(False))
    found = (
        rows.withColumn("_b", F.floor(bit / BITS).cast("int"))
        .withColumn("_at", (bit % BITS).cast("int"))
        .join(F.broadcast(marks), "_b", "left")  # bitmap_buckets rows of 4 KB at most
        .withColumn("_y", byte)
        .withColumn("_again", marked)
    )
    sha = F.unhex(F.sha2(F.col("_t").cast("binary"), 256))
    hashed = settle(
        found.select("_id", "_len", "_pre", "_again", (sha if all_fingerprints else F.when(F.col("_again"), sha)).alias("_sha")),
        "exact-hashes",
    )
    same = (
        hashed.filter("_again").groupBy("_len", "_pre", "_sha").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size")).filter("_size > 1")
    )
    out = hashed.join(same.select("_sha", "_keep", "_size"), "_sha", "left")
    single = F.col("_size").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(single, F.lit(True)).otherwise(F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_sha").alias("fingerprint"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), all_fingerprints=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("fingerprint")).alias("text_sha256"))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

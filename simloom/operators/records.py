"""Records of a container as rows: create, change, remove, compare and merge them by id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create(df: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds rows; of ids that exist already the old row stays. Columns that one side lacks are null."""
    return df.unionByName(rows.join(df.select(id_col), id_col, "left_anti"), allowMissingColumns=True)


def clone(df: DataFrame, source, target, id_col: str = "id") -> DataFrame:
    return create(df, df.filter(F.col(id_col) == source).withColumn(id_col, F.lit(target)), id_col)


def move(df: DataFrame, source, target, id_col: str = "id") -> DataFrame:
    return df.withColumn(id_col, F.when(F.col(id_col) == source, F.lit(target)).otherwise(F.col(id_col)))


def destroy(df: DataFrame, ids: Sequence, id_col: str = "id") -> DataFrame:
    return df.filter(~F.col(id_col).isin(list(ids)))


def contains(df: DataFrame, row_id, id_col: str = "id") -> bool:
    return not df.filter(F.col(id_col) == row_id).limit(1).isEmpty()


def contains_label(df: DataFrame, label: str) -> bool:
    return label in df.columns


def replace_rows(df: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Whole rows by id; rows with a new id are added."""
    return df.join(rows.select(id_col), id_col, "left_anti").unionByName(rows, allowMissingColumns=True)


def assign(df: DataFrame, updates: DataFrame, id_col: str = "id") -> DataFrame:
    """Sets the labels that updates has, on the rows that it names; a null there leaves the old value."""
    new = [c for c in updates.columns if c != id_col]
    joined = df.join(updates.select(id_col, *(F.col(c).alias(f"_n_{c}") for c in new)), id_col, "left")
    old = [F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns]
    return joined.select(*old, *(F.col(f"_n_{c}").alias(c) for c in new if c not in df.columns))


def accumulate(df: DataFrame, updates: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds numbers, and appends texts and arrays, to labels of the rows that updates names."""
    new = [c for c in updates.columns if c != id_col]
    joined = df.join(updates.select(id_col, *(F.col(c).alias(f"_n_{c}") for c in new)), id_col, "left")

    def grown(c: str) -> Column:
        kind, old, more = df.schema[c].dataType.simpleString(), F.col(c), F.col(f"_n_{c}")
        if kind == "string" or kind.startswith("array"):
            return F.when(more.isNull(), old).otherwise(F.concat(old, more))
        return F.when(more.isNull(), old).otherwise(old + more)

    return joined.select(*(grown(c).alias(c) if c in new else F.col(c) for c in df.columns))


def remove_labels(df: DataFrame, labels: Sequence[str], ids: Sequence | None = None, id_col: str = "id") -> DataFrame:
    """Drops labels, or makes them null on the rows named."""
    if ids is None:
        return df.drop(*labels)
    named = F.col(id_col).isin(list(ids))
    return df.withColumns({c: F.when(~named, F.col(c)) for c in labels})


def retrieve(df: DataFrame, row_id, labels: Sequence[str], id_col: str = "id") -> DataFrame:
    return df.filter(F.col(id_col) == row_id).select(*labels)


def retrieve_root(df: DataFrame, row_id, id_col: str = "id") -> DataFrame:
    """(root): the whole row as JSON."""
    return df.filter(F.col(id_col) == row_id).select(F.to_json(F.struct(*df.columns)).alias("root"))


def flatten(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, record): each row as JSON, from which rebuild() makes the table again."""
    return df.select(F.col(id_col), F.to_json(F.struct(*(c for c in df.columns if c != id_col))).alias("record"))


def rebuild(flat: DataFrame, schema: str, id_col: str = "id") -> DataFrame:
    return flat.select(id_col, F.from_json("record", schema).alias("r")).select(id_col, "r.*")


def call_on(df: DataFrame, function: Mapping[str, Column], id_col: str = "id") -> DataFrame:
    """Evaluates expressions on every row."""
    return df.select(id_col, *(c.alias(n) for n, c in function.items()))


def _both(a: DataFrame, b: DataFrame, how: str, id_col: str) -> tuple[DataFrame, list[str]]:
    shared = [c for c in a.columns if c in b.columns and c != id_col]
    left = a.select(id_col, F.lit(True).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in a.columns if c != id_col))
    right = b.select(id_col, F.lit(True).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in b.columns if c != id_col))
    return left.join(right, id_col, how), shared


def intersect(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ids in both, with the labels whose values are the same, null for others."""
    both, shared = _both(a, b, "inner", id_col)
    return both.select(id_col, *(F.when(F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.col(f"_a_{c}")).alias(c) for c in shared))


def union(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ids in either; where both have a label the second's value counts unless it is null."""
    both, shared = _both(a, b, "full", id_col)
    out = [F.coalesce(F.col(f"_b_{c}"), F.col(f"_a_{c}")).alias(c) for c in shared]
    out += [F.col(f"_a_{c}").alias(c) for c in a.columns if c not in b.columns]
    out += [F.col(f"_b_{c}").alias(c) for c in b.columns if c not in a.columns]
    return both.select(id_col, *out)


def difference(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, change, labels): what turns a into b: rows added, removed, or changed, with the labels that differ."""
    both, shared = _both(a, b, "full", id_col)
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in shared)))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size("_c") > 0, "changed")
    rows = both.withColumn("_c", changed).withColumn("change", kind).filter("change is not null")
    return rows.select(id_col, "change", F.when(F.col("change") == "changed", F.col("_c")).otherwise(F.array().cast("array<string>")).alias("labels"))


def patch(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Applies difference(a, b) to a, which gives b."""
    return replace_rows(a.join(b.select(id_col), id_col, "left_semi"), b, id_col)


def mix(a: DataFrame, b: DataFrame, keep_a: float = 0.5, keep_b: float = 0.5, seed: int = 0, id_col: str = "id") -> DataFrame:
    """A random crossing: of ids in both, each label comes from either side in proportion to the chances to keep; other
    rows stay with their own side's chance. The seed, id and label fix every choice."""
    both, shared = _both(a, b, "full", id_col)

    def chance(salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)

    share = keep_a / (keep_a + keep_b) if keep_a + keep_b else 0.5
    values = [F.when(F.col("_b").isNull() | (F.col("_a").isNotNull() & (chance(c) < share)), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in shared]
    stays = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), True).when(F.col("_b").isNull(), chance("") < keep_a).otherwise(chance("") < keep_b)
    return both.filter(stays).select(id_col, *values)


def commonality(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """(commonality): rows of ids in both count one and one for each label with the same value."""
    both, shared = _both(a, b, "inner", id_col)
    same = reduce(lambda x, y: x + y, (F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")).cast("long") for c in shared), F.lit(1))
    return both.agg(F.coalesce(F.sum(same), F.lit(0)).cast("double").alias("commonality"))


def total_size(df: DataFrame) -> DataFrame:
    """(size): nodes of the table: a row and its labels each count one."""
    return df.agg((F.count("*") * len(df.columns)).cast("double").alias("size"))


def edit_distance(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """(distance): sizes of both less twice what they have in common."""
    sizes = total_size(a).withColumnRenamed("size", "x").crossJoin(total_size(b).withColumnRenamed("size", "y"))
    return sizes.crossJoin(commonality(a, b, id_col)).select((F.col("x") + F.col("y") - 2 * F.col("commonality")).alias("distance"))


def mutate(df: DataFrame, rate: float, scale: float = 0.1, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Changes each number with a chance of rate by up to scale of itself, and swaps in the text's reverse likewise."""

    def draw(c: str, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.lit(c), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)

    def changed(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        hit = draw(c, 0) < rate
        if kind == "string":
            return F.when(hit, F.reverse(c)).otherwise(F.col(c))
        if kind in ("double", "float"):
            return F.when(hit, F.col(c) * (1 + scale * (2 * draw(c, 1) - 1))).otherwise(F.col(c))
        return F.col(c)

    return df.select(*(F.col(c) if c == id_col else changed(c).alias(c) for c in df.columns))

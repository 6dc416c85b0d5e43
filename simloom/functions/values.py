"""Value model: numbers are doubles, NaN is null, strings compare in natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN becomes null; everything numeric is a double."""
    d = x.cast("double")
    return F.when(~F.isnan(d), d)


def to_number(x: Column, kind: str) -> Column:
    """Booleans become 0 or 1, numeric strings their value, other strings null. kind: the column's simple type name."""
    if kind == "string":
        return clean(x.try_cast("double"))
    return clean(x)


def to_bool(x: Column, kind: str) -> Column:
    """False for null, false, 0 and the empty string; true for all else, empty arrays and maps too."""
    if kind == "boolean":
        return F.coalesce(x, F.lit(False))
    if kind == "string":
        return F.coalesce(x != "", F.lit(False))
    if kind.startswith(("array", "map", "struct")):
        return x.isNotNull()
    return F.coalesce(clean(x) != 0, F.lit(False))


def natural_key(x: Column) -> Column:
    """A string whose plain order is the natural order of x: white space is skipped, runs of digits count as numbers.

    Leading zeros are dropped and each run is preceded by its length, so longer numbers sort later; ties between
    numbers that are equal but written with different zeros fall back to the raw text at the end.
    """
    bare = F.regexp_replace(x, r"\s+", "")
    parts = F.regexp_extract_all(bare, F.lit(r"(\d+|\D+)"), F.lit(1))

    def piece(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(p)

    return F.concat(F.array_join(F.transform(parts, piece), ""), F.lit("\u0000"), x)


def number_text(x: Column) -> Column:
    """Shortest text of a number that reads back the same; whole numbers carry no decimals."""
    d = clean(x)
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return (
        F.when(d.isNull(), F.lit(".null"))
        .when(d == float("inf"), F.lit(".infinity"))
        .when(d == float("-inf"), F.lit("-.infinity"))
        .when(whole, d.cast("bigint").cast("string"))
        .otherwise(d.cast("string"))
    )


def type_name(kind: str) -> str:
    """Name of the runtime type that a column of a Spark type has."""
    if kind == "boolean":
        return "bool"
    if kind == "string":
        return "string"
    if kind.startswith("array"):
        return "list"
    if kind.startswith(("map", "struct")):
        return "assoc"
    return "number"

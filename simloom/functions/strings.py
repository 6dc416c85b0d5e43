"""String functions on Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import number_text


def characters(s: Column, stride: int = 0) -> Column:
    """Single characters, or chunks of stride bytes (as text of those bytes)."""
    if not stride:
        return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    raw = s.cast("binary")
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(s), F.lit(1)), F.lit(stride))
    return F.when(F.octet_length(s) > 0, F.transform(starts, lambda i: F.substring(raw, i, F.lit(stride)).cast("string"))).otherwise(F.array().cast("array<string>"))


def split(s: Column, pattern: str | None = None, most: int | None = None) -> Column:
    """Splits at matches of a regular expression, at most so often; without a pattern the whole is one part."""
    if pattern is None:
        return F.array(s)
    return F.split(s, pattern, -1 if most is None else most + 1)


def substring(s: Column, offset: int, length: int | None = None) -> Column:
    """Characters from an offset, which counts from the end if negative; a negative length leaves so many off the end."""
    start = F.lit(offset) if offset >= 0 else F.greatest(F.length(s) + offset, F.lit(0))
    if length is None:
        size = F.length(s)
    elif length >= 0:
        size = F.lit(length)
    else:
        size = F.greatest(F.length(s) + length - start, F.lit(0))
    return F.substring(s, start + 1, size)


def first_match(s: Column, pattern: str) -> Column:
    """The first match of a regular expression, null without one."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 0))


def all_matches(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def replace(s: Column, pattern: str, replacement: str, most: int | None = None) -> Column:
    """Replaces all matches, or the first `most`."""
    if most is None:
        return F.regexp_replace(s, pattern, replacement)
    if most < 1:
        return s
    # What follows the match number `most` is the last part of a split; all matches before it are replaced.
    rest = F.element_at(F.split(s, pattern, most + 1), -1)
    head = F.substring(s, F.lit(1), F.length(s) - F.length(rest))
    return F.concat(F.regexp_replace(head, pattern, replacement), rest)


def join(*parts: tuple[Column, str]) -> Column:
    """Concatenates text; numbers in their shortest form. Parts are (column, type)."""
    return F.concat(*(x if k == "string" else number_text(x) for x, k in parts))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is one long number, a bit a character of a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        some = row & places.get(y, 0)
        row = (row + some | row - some) & full
    return len(a) - row.bit_count()


def _of_pairs(f):
    """A function of two texts as one of two columns; null if either is. Texts come in Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(f(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return work


#: Insertions and deletions that turn a into b; a substitution counts as both.
edit_distance = _of_pairs(lambda a, b: len(a) + len(b) - 2 * lcs_length(a, b))
#: Characters in the longest common subsequence.
commonality = _of_pairs(lcs_length)

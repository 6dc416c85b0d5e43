"""Functions on arrays, maps and strings as containers, and their iteration."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _slice(a: Column, start: Column, count: Column) -> Column:
    return F.slice(a, start, F.greatest(count, F.lit(0)))


def tail(a: Column, keep: int = -1) -> Column:
    """The last `keep` elements; a negative number leaves so many off the front."""
    n = F.least(F.lit(keep), F.size(a)) if keep >= 0 else F.greatest(F.size(a) + keep, F.lit(0))
    return _slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def trunc(a: Column, keep: int = -1) -> Column:
    """The first `keep` elements; a negative number leaves so many off the end."""
    return _slice(a, F.lit(1), F.lit(keep) if keep >= 0 else F.size(a) + keep)


def append(*collections: Column) -> Column:
    return F.concat(*collections)


def merge_maps(*maps: Column) -> Column:
    """Later values win."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(two, maps)


def size(c: Column) -> Column:
    return F.size(c).cast("double")


def get(a: Column, index: int) -> Column:
    """Element at a place from 0, from the end if negative; null outside."""
    return F.get(a, F.lit(index) if index >= 0 else F.size(a) + index)


def walk(x: Column, *path: int | str) -> Column:
    """Follows places and keys into nested arrays, maps and structs."""
    for step in path:
        x = get(x, step) if isinstance(step, int) else x[step]
    return x


def replace_at(a: Column, index: int, value: Column | Callable[[Column], Column]) -> Column:
    at = F.lit(index) if index >= 0 else F.size(a) + index
    return F.transform(a, lambda e, i: F.when(i == at, value(e) if callable(value) else value).otherwise(e))


def replace_key(m: Column, key: str, value: Column | Callable[[Column], Column]) -> Column:
    return F.transform_values(m, lambda k, v: F.when(k == key, value(v) if callable(value) else value).otherwise(v))


def indices(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def keys(m: Column) -> Column:
    return F.map_keys(m)


def values(c: Column, is_map: bool = False, unique: bool = False) -> Column:
    out = F.map_values(c) if is_map else c
    return F.array_distinct(out) if unique else out


def contains_index(a: Column, index: int) -> Column:
    return F.size(a) > index if index >= 0 else F.size(a) >= -index


def contains_key(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def contains_value(a: Column, value) -> Column:
    return F.coalesce(F.array_contains(a, value), F.lit(False))


def remove(a: Column, *places: int) -> Column:
    return F.filter(a, lambda _, i: reduce(lambda x, y: x & y, (i != (F.lit(p) if p >= 0 else F.size(a) + p) for p in places)))


def keep(a: Column, *places: int) -> Column:
    return F.filter(a, lambda _, i: reduce(lambda x, y: x | y, (i == (F.lit(p) if p >= 0 else F.size(a) + p) for p in places)))


def remove_keys(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))


def keep_keys(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*names))


def number_range(low: Column, high: Column, step: float = 1.0, function: Callable[[Column], Column] | None = None) -> Column:
    """Numbers from low to high, both included, as doubles."""
    n = F.floor((high - low) / step + 1e-9).cast("int")
    out = F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: low.cast("double") + i * F.lit(float(step)))).otherwise(F.array().cast("array<double>"))
    return F.transform(out, function) if function else out


def map_over(function: Callable[..., Column], *arrays: Column) -> Column:
    """Applies a function to the elements at the same place of one or more arrays; shorter ones are filled with null."""
    if len(arrays) == 1:
        return F.transform(arrays[0], function)
    if len(arrays) == 2:
        return F.zip_with(arrays[0], arrays[1], function)
    zipped = F.arrays_zip(*(a.alias(f"_{i}") for i, a in enumerate(arrays)))
    return F.transform(zipped, lambda e: function(*(e[f"_{i}"] for i in range(len(arrays)))))


def keep_where(a: Column, test: Callable[[Column], Column] | None = None) -> Column:
    """Elements for which test holds; without one, those that aren't null."""
    return F.filter(a, test) if test else F.array_compact(a)


def weave(*arrays: Column) -> Column:
    """Interleaves arrays; shorter ones are filled with null."""
    zipped = F.arrays_zip(*(a.alias(f"_{i}") for i, a in enumerate(arrays)))
    return F.flatten(F.transform(zipped, lambda e: F.array(*(e[f"_{i}"] for i in range(len(arrays))))))


def fold(a: Column, function: Callable[[Column, Column], Column]) -> Column:
    """Left fold that starts with the first element; null for an empty array."""
    return F.when(F.size(a) > 0, F.aggregate(tail(a), first(a), function))


def associate(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))


def zip_map(names: Column, vals: Column, combine: Callable[[Column, Column], Column] | None = None) -> Column:
    """Map of keys and values; for keys that repeat, the last value or what combine makes of them in order."""
    pairs = F.arrays_zip(names.alias("k"), vals.alias("v"))

    def value(k: Column) -> Column:
        own = F.transform(F.filter(pairs, lambda e: e["k"] == k), lambda e: e["v"])
        return fold(own, combine) if combine else last(own)

    unique = F.array_distinct(names)
    return F.map_from_arrays(unique, F.transform(unique, value))


def unzip(m: Column, names: Column) -> Column:
    return F.transform(names, lambda k: F.try_element_at(m, k))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def sort(a: Column, k: int | None = None, descending: bool = False, compare: Callable[[Column, Column], Column] | None = None) -> Column:
    """Sorted array, or its first k elements; a negative k takes the last k, in reverse."""
    out = F.array_sort(a, compare) if compare else F.sort_array(a, asc=not descending)
    if k is None:
        return out
    return trunc(out, k) if k >= 0 else F.reverse(tail(out, -k))


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def total_size(a: Column) -> Column:
    """Nodes of an array of simple values: the array and its elements."""
    return (F.size(a) + 1).cast("double")

"""Registered scalar queries: a function applied to every row of a table, with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import containers as C
from ..functions import formats as X
from ..functions import logic as L
from ..functions import math as M
from ..functions import random as R
from ..functions import strings as S
from ..functions import trees as T
from ..functions import values as V


def c(name: str):
    return F.col(name)


#: Numbers that come out of transcendental functions are compared to so many decimals.
DIGITS = 6

NUMBERS = "part", "p_partkey"
ACCOUNTS = "customer", "c_custkey"
ORDERS = "orders", "o_orderkey"
VECTORS = "embeddings", "vec_id"
EVENTS = "events", "event_id"


def near(x):
    return F.round(x, DIGITS)


def arr(*names: str):
    return F.array(*(c(n).cast("double") for n in names))


def part():
    return arr("p_size", "p_retailprice", "p_partkey")


def vec():
    return c("embedding").cast("array<double>")


def words():
    return F.split(c("p_name"), " ")


def pairs():
    return F.create_map(F.lit("size"), c("p_size").cast("double"), F.lit("price"), c("p_retailprice"))


PART_SQL = "[p_size::DOUBLE, p_retailprice, p_partkey::DOUBLE]"
VEC_SQL = "embedding::DOUBLE[]"
WORDS_SQL = "string_split(p_name, ' ')"

#: name: (table and key, Column, SQL expression or None where SQL has no equal)
SCALARS = {
    # basic math
    "add": (NUMBERS, lambda: M.add(c("p_size"), c("p_retailprice"), F.lit(1)), "p_size + p_retailprice + 1"),
    "subtract": (NUMBERS, lambda: M.subtract(c("p_retailprice"), c("p_size"), F.lit(2)), "p_retailprice - p_size - 2"),
    "negate": (NUMBERS, lambda: M.subtract(c("p_size")), "-(p_size::DOUBLE)"),
    "multiply": (NUMBERS, lambda: M.multiply(c("p_size"), c("p_retailprice")), "p_size * p_retailprice"),
    "divide": (NUMBERS, lambda: M.divide(c("p_retailprice"), c("p_size") - 10), "CASE WHEN p_size = 10 THEN 'inf'::DOUBLE ELSE p_retailprice / (p_size - 10) END"),
    "reciprocal": (NUMBERS, lambda: M.divide(c("p_size")), "1.0::DOUBLE / p_size"),
    "mod": (NUMBERS, lambda: M.mod(c("p_size") - 25, F.lit(7)), "((p_size - 25) % 7)::DOUBLE"),
    "get_digits": (NUMBERS, lambda: F.array_join(F.transform(M.get_digits(c("p_partkey"), 10, 3, 0), lambda d: d.cast("int")), ","),
                   "concat_ws(',', (p_partkey // 1000) % 10, (p_partkey // 100) % 10, (p_partkey // 10) % 10, p_partkey % 10)"),
    "set_digits": (NUMBERS, lambda: M.set_digits(c("p_partkey"), 10, [5, None, 7], 2), "(p_partkey // 1000 * 1000 + 500 + (p_partkey // 10) % 10 * 10 + 7)::DOUBLE"),
    "floor": (NUMBERS, lambda: M.floor(c("p_retailprice") / 7), "floor(p_retailprice / 7)"),
    "ceil": (NUMBERS, lambda: M.ceil(c("p_retailprice") / 7), "ceil(p_retailprice / 7)"),
    "round": (NUMBERS, lambda: M.round_to(c("p_retailprice")), "round(p_retailprice)"),
    "round_significant": (NUMBERS, lambda: M.round_to(c("p_partkey"), 2),
                          "CASE WHEN p_partkey < 100 THEN p_partkey::DOUBLE ELSE floor(p_partkey / pow(10, floor(log10(p_partkey)) - 1) + 0.5) * pow(10, floor(log10(p_partkey)) - 1) END"),
    "abs": (ACCOUNTS, lambda: F.abs(V.clean(c("c_acctbal"))), "abs(c_acctbal)"),
    "max": (NUMBERS, lambda: M.maximum(c("p_size"), c("p_partkey")), "greatest(p_size, p_partkey)::DOUBLE"),
    "min": (NUMBERS, lambda: M.minimum(c("p_size"), c("p_partkey")), "least(p_size, p_partkey)::DOUBLE"),
    "index_max": (NUMBERS, lambda: F.array_join(M.index_of_max(part()), ","), f"(list_position({PART_SQL}, list_max({PART_SQL})) - 1)::VARCHAR"),
    "index_min": (NUMBERS, lambda: F.get(M.index_of_min(part()), F.lit(0)), f"list_position({PART_SQL}, list_min({PART_SQL})) - 1"),
    "keys_of_max": (NUMBERS, lambda: F.array_join(M.keys_of_max(pairs()), ","), "CASE WHEN p_size > p_retailprice THEN 'size' ELSE 'price' END"),
    "keys_of_min": (NUMBERS, lambda: F.array_join(M.keys_of_min(pairs()), ","), "CASE WHEN p_size < p_retailprice THEN 'size' ELSE 'price' END"),
    # advanced math
    "exp": (NUMBERS, lambda: near(M.exp(c("p_size") / 10)), "round(exp(p_size / 10), 6)"),
    "log": (NUMBERS, lambda: near(M.log(c("p_retailprice"))), "round(ln(p_retailprice), 6)"),
    "log_base": (NUMBERS, lambda: near(M.log(c("p_retailprice"), 2)), "round(log2(p_retailprice), 6)"),
    "log_of_zero": (NUMBERS, lambda: M.log(c("p_size") * 0), "'-inf'::DOUBLE"),
    "erf": (NUMBERS, lambda: F.round(M.erf(c("p_size") / 50), 9),
        "round(1.1283791670955126 * list_sum(list_transform(range(0, 40), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(p_size / 50, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))), 9)"),
    "gamma": (NUMBERS, lambda: near(M.gamma(c("p_size") % 7 + 1.5)), "round(gamma(p_size % 7 + 1.5), 6)"),
    "lgamma": (NUMBERS, lambda: near(M.lgamma(c("p_size") + 0.5)), "round(lgamma(p_size + 0.5), 6)"),
    "sqrt": (ACCOUNTS, lambda: near(M.sqrt(c("c_acctbal"))), "CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END"),
    "pow": (NUMBERS, lambda: near(M.power(c("p_size"), F.lit(1.5))), "round(pow(p_size, 1.5), 6)"),
    "dot_product": (VECTORS, lambda: near(M.dot(vec(), vec())), f"round(list_dot_product({VEC_SQL}, {VEC_SQL}), 6)"),
    "dot_product_maps": (NUMBERS, lambda: M.dot_maps(pairs(), F.create_map(F.lit("size"), F.lit(2.0))), "p_size * 2.0::DOUBLE"),
    "normalize": (VECTORS, lambda: near(F.get(M.normalize(vec(), 2), F.lit(0))), f"round(embedding[1]::DOUBLE / sqrt(list_dot_product({VEC_SQL}, {VEC_SQL})), 6)"),
    "array_mode": (NUMBERS, lambda: M.array_mode(F.array(c("p_size") % 3, c("p_size") % 2, F.lit(1)).cast("array<double>")),
                   "CASE WHEN p_size % 3 = 1 OR p_size % 2 = 1 THEN 1 WHEN p_size % 3 = p_size % 2 THEN p_size % 3 ELSE least(p_size % 3, p_size % 2, 1) END::DOUBLE"),
    "array_quantile": (VECTORS, lambda: near(M.array_quantile(vec(), 0.3)), f"round(list_aggregate({VEC_SQL}, 'quantile_cont', 0.3), 6)"),
    "array_generalized_mean": (NUMBERS, lambda: near(M.array_generalized_mean(F.array(c("p_size"), c("p_retailprice")), 2.0)), "round(sqrt((p_size * p_size + p_retailprice * p_retailprice) / 2), 6)"),
    "array_geometric_mean": (NUMBERS, lambda: near(M.array_generalized_mean(F.array(c("p_size"), c("p_retailprice")), 0)), "round(exp((ln(p_size) + ln(p_retailprice)) / 2), 6)"),
    "entropy": (NUMBERS, lambda: near(M.entropy(F.array(c("p_size") / 60, 1 - c("p_size") / 60))), "round(-(p_size / 60 * ln(p_size / 60) + (1 - p_size / 60) * ln(1 - p_size / 60)), 6)"),
    "kl_divergence": (NUMBERS, lambda: near(-M.entropy(F.array(c("p_size") / 60, 1 - c("p_size") / 60), F.array(F.lit(0.5), F.lit(0.5)), 1.0, -1.0)),
                      "round(p_size / 60 * ln(p_size / 60 / 0.5) + (1 - p_size / 60) * ln((1 - p_size / 60) / 0.5), 6)"),
    # trigonometry
    **{n: (NUMBERS, (lambda f: lambda: near(f(c("p_size") / 51)))(getattr(M, n)), f"round({n}(p_size / 51), 6)") for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")},
    "acosh": (NUMBERS, lambda: near(M.acosh(c("p_size") + 1)), "round(acosh(p_size + 1), 6)"),
    "atan2": (NUMBERS, lambda: near(M.atan(c("p_size"), c("p_retailprice"))), "round(atan2(p_size, p_retailprice), 6)"),
    # logic and comparison
    "and": (NUMBERS, lambda: L.all_of((c("p_size") % 2, "int"), (c("p_size"), "int")), "CASE WHEN p_size % 2 <> 0 AND p_size <> 0 THEN p_size END"),
    "or": (NUMBERS, lambda: L.any_of((c("p_size") % 2, "int"), (c("p_size"), "int")), "CASE WHEN p_size % 2 <> 0 THEN p_size % 2 WHEN p_size <> 0 THEN p_size END"),
    "xor": (NUMBERS, lambda: L.odd_of((c("p_size") % 2, "int"), (c("p_size") % 3, "int")), "(p_size % 2 <> 0) <> (p_size % 3 <> 0)"),
    "not": (NUMBERS, lambda: L.negation(c("p_size") % 2, "int"), "p_size % 2 = 0"),
    "equal": (NUMBERS, lambda: L.equal(c("p_size") % 3, c("p_size") % 2, F.lit(1)), "p_size % 3 = 1 AND p_size % 2 = 1"),
    "not_equal": (NUMBERS, lambda: L.unequal(c("p_size") % 3, c("p_size") % 2, F.lit(2)), "p_size % 3 <> p_size % 2 AND p_size % 3 <> 2"),
    "less": (NUMBERS, lambda: L.less(F.lit(5), c("p_size"), c("p_partkey")), "5 < p_size AND p_size < p_partkey"),
    "less_equal": (NUMBERS, lambda: L.less_equal(F.lit(5), c("p_size"), c("p_partkey")), "5 <= p_size AND p_size <= p_partkey"),
    "greater": (NUMBERS, lambda: L.greater(c("p_size"), F.lit(20), F.nullif(c("p_size") % 4, F.lit(0))), "coalesce(p_size > 20 AND 20 > nullif(p_size % 4, 0), false)"),
    "greater_equal": (NUMBERS, lambda: L.greater_equal(c("p_size"), F.lit(20)), "p_size >= 20"),
    "same_type": (NUMBERS, lambda: L.same_type("int", "double"), "true"),
    "no_same_type": (NUMBERS, lambda: L.no_same_type("int", "string"), "true"),
    "if": (NUMBERS, lambda: L.choose((c("p_size") < 10, F.lit("small")), (c("p_size") < 30, F.lit("medium")), otherwise=F.lit("large")), "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END"),
    "get_type_string": (NUMBERS, lambda: F.lit(V.type_name("int")), "'number'"),
    "to_number": (ORDERS, lambda: V.to_number(F.substring("o_orderpriority", 1, 1), "string"), "substr(o_orderpriority, 1, 1)::DOUBLE"),
    "number_text": (NUMBERS, lambda: V.number_text(c("p_size")), "p_size::VARCHAR"),
    # strings
    "explode": (NUMBERS, lambda: F.array_join(S.characters(c("p_name")), "|"), "array_to_string(regexp_extract_all(p_name, '.'), '|')"),
    "explode_stride": (NUMBERS, lambda: F.array_join(S.characters(c("p_brand"), 3), "|"), "array_to_string(regexp_extract_all(p_brand, '.{1,3}'), '|')"),
    "split": (NUMBERS, lambda: F.array_join(S.split(c("p_name"), "[aeiou]"), "|"), "array_to_string(regexp_split_to_array(p_name, '[aeiou]'), '|')"),
    "split_most": (NUMBERS, lambda: F.get(S.split(c("p_name"), " ", 1), F.lit(1)), "substr(p_name, strpos(p_name, ' ') + 1)"),
    "substr": (NUMBERS, lambda: S.substring(c("p_name"), 2, 4), "substr(p_name, 3, 4)"),
    "substr_negative": (NUMBERS, lambda: S.substring(c("p_name"), -3), "right(p_name, 3)"),
    "substr_match": (NUMBERS, lambda: S.first_match(c("p_name"), "[a-m]+"), "nullif(regexp_extract(p_name, '[a-m]+'), '')"),
    "substr_all": (NUMBERS, lambda: F.array_join(S.all_matches(c("p_name"), "[aeiou]"), ""), "array_to_string(regexp_extract_all(p_name, '[aeiou]'), '')"),
    "substr_replace": (NUMBERS, lambda: S.replace(c("p_name"), "[aeiou]", "*"), "regexp_replace(p_name, '[aeiou]', '*', 'g')"),
    "substr_replace_first": (NUMBERS, lambda: S.replace(c("p_name"), "[aeiou]", "*", 1), "regexp_replace(p_name, '[aeiou]', '*')"),
    "concat": (NUMBERS, lambda: S.join((c("p_brand"), "string"), (F.lit(":"), "string"), (c("p_size"), "int")), "p_brand || ':' || p_size"),
    "string_edit_distance": (NUMBERS, lambda: S.edit_distance(c("p_brand"), c("p_type")), None),
    "string_commonality": (NUMBERS, lambda: S.commonality(c("p_brand"), c("p_type")), None),
    "natural_key": (NUMBERS, lambda: F.substring_index(V.natural_key(c("p_brand")), "\u0000", 1) < F.substring_index(V.natural_key(F.lit("Brand#9")), "\u0000", 1), "substr(p_brand, 7)::INT < 9"),
    # containers
    "first": (NUMBERS, lambda: C.first(words()), f"{WORDS_SQL}[1]"),
    "last": (NUMBERS, lambda: C.last(words()), f"{WORDS_SQL}[-1]"),
    "tail": (NUMBERS, lambda: F.array_join(C.tail(part().cast("array<bigint>")), ","), "concat_ws(',', trunc(p_retailprice)::BIGINT, p_partkey)"),
    "trunc": (NUMBERS, lambda: F.array_join(C.trunc(part().cast("array<bigint>"), 2), ","), "concat_ws(',', p_size, trunc(p_retailprice)::BIGINT)"),
    "append": (NUMBERS, lambda: F.array_join(C.append(words(), F.array(c("p_type"))), "|"), f"array_to_string(list_append({WORDS_SQL}, p_type), '|')"),
    "merge_maps": (NUMBERS, lambda: C.merge_maps(pairs(), F.create_map(F.lit("size"), F.lit(-1.0)))["size"], "-1.0::DOUBLE"),
    "size": (NUMBERS, lambda: C.size(words()), f"len({WORDS_SQL})::DOUBLE"),
    "get": (NUMBERS, lambda: C.get(words(), -1), f"{WORDS_SQL}[-1]"),
    "get_walk": (EVENTS, lambda: X.json_value(c("props"), "$.k", "int"), "(props->>'$.k')::INT"),
    "modify": (NUMBERS, lambda: F.array_join(C.replace_at(words(), 0, F.upper), " "), f"upper({WORDS_SQL}[1]) || substr(p_name, len({WORDS_SQL}[1]) + 1)"),
    "modify_key": (NUMBERS, lambda: C.replace_key(pairs(), "size", lambda v: v * 2)["size"], "p_size * 2.0::DOUBLE"),
    "indices": (NUMBERS, lambda: F.array_join(C.indices(words()), ","), f"array_to_string(range(len({WORDS_SQL})), ',')"),
    "keys": (NUMBERS, lambda: F.array_join(C.keys(pairs()), ","), "'size,price'"),
    "values": (NUMBERS, lambda: F.array_join(C.values(F.array(c("p_size") % 3, c("p_size") % 2), unique=True), ","), "CASE WHEN p_size % 3 = p_size % 2 THEN (p_size % 3)::VARCHAR ELSE concat_ws(',', p_size % 3, p_size % 2) END"),
    "contains_index": (NUMBERS, lambda: C.contains_index(words(), 1), f"len({WORDS_SQL}) > 1"),
    "contains_key": (NUMBERS, lambda: C.contains_key(pairs(), "price"), "true"),
    "contains_value": (NUMBERS, lambda: C.contains_value(words(), "red"), f"list_contains({WORDS_SQL}, 'red')"),
    "remove": (NUMBERS, lambda: F.array_join(C.remove(words(), 0), " "), f"array_to_string({WORDS_SQL}[2:], ' ')"),
    "keep": (NUMBERS, lambda: F.array_join(C.keep(words(), -1), " "), f"{WORDS_SQL}[-1]"),
    "remove_keys": (NUMBERS, lambda: F.size(C.remove_keys(pairs(), "size")), "1"),
    "keep_keys": (NUMBERS, lambda: C.keep_keys(pairs(), "size")["size"], "p_size::DOUBLE"),
    # iteration
    "range": (NUMBERS, lambda: F.array_join(F.transform(C.number_range(F.lit(0), c("p_size") % 5, 2.0), lambda x: x.cast("int")), ","), "array_to_string(range(0, p_size % 5 + 1, 2), ',')"),
    "map": (VECTORS, lambda: near(M.add(F.aggregate(C.map_over(lambda x: x * x, vec()), F.lit(0.0), lambda a, x: a + x))), f"round(list_sum(list_transform({VEC_SQL}, lambda x: x * x)), 6)"),
    "map_two": (NUMBERS, lambda: F.array_join(C.map_over(lambda a, b: F.concat(F.coalesce(a, F.lit("-")), F.coalesce(b, F.lit("-"))), words(), F.array(F.lit("x"))), "|"), f"{WORDS_SQL}[1] || 'x|' || array_to_string(list_transform({WORDS_SQL}[2:], lambda w: w || '-'), '|')"),
    "filter": (VECTORS, lambda: F.size(C.keep_where(vec(), lambda x: x > 0)), f"len(list_filter({VEC_SQL}, lambda x: x > 0))"),
    "filter_nulls": (NUMBERS, lambda: F.size(C.keep_where(F.array(F.nullif(c("p_size") % 2, F.lit(0)), F.lit(1)))), "1 + p_size % 2"),
    "weave": (NUMBERS, lambda: F.array_join(C.weave(words(), F.array(F.lit("x"), F.lit("y"))), "|"), f"{WORDS_SQL}[1] || '|x|' || {WORDS_SQL}[2] || '|y'"),
    "reduce": (NUMBERS, lambda: C.fold(part(), lambda a, x: a * 2 + x), "(p_size * 2 + p_retailprice) * 2 + p_partkey"),
    "associate": (NUMBERS, lambda: C.associate(("a", c("p_size")), ("b", c("p_size") + 1))["b"], "p_size + 1"),
    "zip": (NUMBERS, lambda: C.zip_map(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(c("p_size"), F.lit(0), c("p_size") + 1))["a"], "p_size + 1"),
    "zip_combine": (NUMBERS, lambda: C.zip_map(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(c("p_size"), F.lit(0), c("p_size") + 1), lambda a, b: a + b)["a"], "2 * p_size + 1"),
    "unzip": (NUMBERS, lambda: F.array_join(C.unzip(F.create_map(F.lit("a"), c("p_size"), F.lit("b"), c("p_size") + 1), F.array(F.lit("b"), F.lit("a"))), ","), "concat_ws(',', p_size + 1, p_size)"),
    "reverse": (NUMBERS, lambda: F.array_join(C.reverse(words()), " "), f"array_to_string(list_reverse({WORDS_SQL}), ' ')"),
    "sort": (NUMBERS, lambda: F.array_join(C.sort(words()), " "), f"array_to_string(list_sort({WORDS_SQL}), ' ')"),
    "sort_descending": (NUMBERS, lambda: F.array_join(C.sort(words(), descending=True), " "), f"array_to_string(list_reverse_sort({WORDS_SQL}), ' ')"),
    "sort_k": (VECTORS, lambda: near(C.last(C.sort(vec(), 3))), f"round(list_sort({VEC_SQL})[3], 6)"),
    "list_intersect": (NUMBERS, lambda: F.array_join(F.array_sort(C.intersect(words(), F.array(F.lit("red"), F.lit("ring")))), ","), f"coalesce(array_to_string(list_sort(list_intersect({WORDS_SQL}, ['red', 'ring'])), ','), '')"),
    "list_union": (NUMBERS, lambda: F.array_join(F.array_sort(C.union(words(), F.array(F.lit("red")))), ","), f"array_to_string(list_sort(list_distinct(list_append({WORDS_SQL}, 'red'))), ',')"),
    "list_difference": (NUMBERS, lambda: F.array_join(F.array_sort(C.difference(words(), F.array(F.lit("red")))), ","), f"coalesce(array_to_string(list_sort(list_distinct(list_filter({WORDS_SQL}, lambda w: w <> 'red'))), ','), '')"),
    "total_size": (NUMBERS, lambda: C.total_size(words()), f"len({WORDS_SQL}) + 1.0::DOUBLE"),
    # formats
    "to_base16": (NUMBERS, lambda: X.to_base16(c("p_name")), "lower(hex(p_name))"),
    "from_base16": (NUMBERS, lambda: X.from_base16(X.to_base16(c("p_name"))), "p_name"),
    "to_base64": (NUMBERS, lambda: X.to_base64(c("p_name")), "base64(p_name::BLOB)"),
    "from_base64": (NUMBERS, lambda: X.from_base64(X.to_base64(c("p_name"))), "p_name"),
    "pack_int32": (NUMBERS, lambda: F.hex(X.pack_number(c("p_partkey"), "int32", True)), "printf('%08X', p_partkey)"),
    "unpack_double": (NUMBERS, lambda: X.unpack_number(X.pack_number(c("p_retailprice"), "double"), "double"), "p_retailprice"),
    "date_to_number": (ORDERS, lambda: X.epoch_seconds(c("o_orderdate")), "epoch(o_orderdate)"),
    "number_to_date": (ORDERS, lambda: X.date_text(X.epoch_seconds(c("o_orderdate")), "%Y-%m-%d %H:%M:%S"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
    "parse_date": (ORDERS, lambda: X.parse_date(F.date_format("o_orderdate", "dd/MM/yyyy"), "%d/%m/%Y"), "epoch(date_trunc('day', o_orderdate))"),
    "time_of_day": (EVENTS, lambda: near(X.time_of_day(c("ts"))), "round(epoch(ts) % 86400, 6)"),
    "to_json": (NUMBERS, lambda: X.to_json(F.struct("p_partkey", "p_name")), "'{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\"}'"),
    "from_json": (EVENTS, lambda: X.from_json(c("props"), "k int")["k"], "(props->>'$.k')::INT"),
    "json_to_yaml": (EVENTS, lambda: X.json_to_yaml(c("props")), "'k: ' || (props->>'$.k') || chr(10)"),
    # trees as JSON
    "tree_size": (EVENTS, lambda: T.total_size(c("props")), "2.0::DOUBLE"),
    "tree_commonality": (EVENTS, lambda: T.commonality(c("props"), F.lit('{"k": 7}')), "1.0::DOUBLE + ((props->>'$.k')::INT = 7)::INT"),
    "tree_edit_distance": (EVENTS, lambda: T.edit_distance(c("props"), F.lit('{"k": 7}')), "2.0::DOUBLE - 2 * ((props->>'$.k')::INT = 7)::INT"),
    "tree_intersect": (EVENTS, lambda: T.tree_intersect(c("props"), F.lit('{"k": 7}')), "CASE WHEN (props->>'$.k')::INT = 7 THEN '{\"k\": 7}' ELSE '{}' END"),
    "tree_union": (EVENTS, lambda: T.tree_union(c("props"), F.lit('{"j": 1}')), "'{\"j\": 1, \"k\": ' || (props->>'$.k') || '}'"),
    "tree_patch": (EVENTS, lambda: T.tree_patch(c("props"), T.tree_difference(c("props"), F.lit('{"j": 1}'))), "'{\"j\": 1}'"),
    "tree_mix": (EVENTS, lambda: T.tree_mix(0.5, 0.5, 3)(c("props"), F.lit('{"j": 1}')), None),
    "tree_mutate": (EVENTS, lambda: T.tree_mutate(0.5, 3)(c("props")), None),
    "tree_rewrite": (EVENTS, lambda: T.tree_rewrite(lambda x: x + 1 if isinstance(x, int) else x)(c("props")), "'{\"k\": ' || ((props->>'$.k')::INT + 1) || '}'"),
    # random values, fixed by seed and key
    "rand": (NUMBERS, lambda: R.uniform(1, c("p_partkey")), None),
    "rand_choice": (NUMBERS, lambda: R.choice(1, words(), c("p_partkey")), None),
    "rand_weighted": (NUMBERS, lambda: R.weighted_choice(1, {"a": 3.0, "b": 1.0}, c("p_partkey")), None),
    "rand_unique": (NUMBERS, lambda: F.size(R.unique_choice(1, words(), 1, c("p_partkey"))), "1"),
    "rand_draws": (NUMBERS, lambda: F.size(R.draws(1, 4, c("p_partkey"))), "4"),
}


def queries() -> dict:
    def one(place, column):
        table, key = place
        return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, column().alias("out"))

    return {f"fn_{n}": one(place, column) for n, (place, column, _) in SCALARS.items()}


def oracle_sql() -> dict[str, str]:
    return {f"fn_{n}": f"SELECT {place[1]}, {sql} AS out FROM {place[0]}" for n, (place, _, sql) in SCALARS.items() if sql}

"""Conversions between numbers, text, bytes, JSON, YAML, dates and times."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import clean

# Packed number formats and the codes that pack them, little-endian and big-endian.
PACKED = {
    "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q",
    "float": "f", "double": "d",
}
# Strftime fields and the patterns of Spark's date functions.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%",
}


def date_pattern(strftime: str) -> str:
    """A strftime pattern in Spark's terms; letters outside of fields are quoted."""
    out, i = "", 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            out += STRFTIME[strftime[i + 1]]
            i += 2
        else:
            out += f"'{c}'" if c.isalpha() else c
            i += 1
    return out


def epoch_seconds(t: Column) -> Column:
    """A timestamp as seconds since the epoch, with fractions."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def date_text(seconds: Column, strftime: str, zone: str = "UTC") -> Column:
    """Seconds since the epoch as text in a time zone."""
    t = F.timestamp_micros((seconds * 1e6).cast("bigint"))
    return F.date_format(F.from_utc_timestamp(t, zone), date_pattern(strftime))


def parse_date(text: Column, strftime: str, zone: str = "UTC") -> Column:
    """Text in a time zone as seconds since the epoch; null if it doesn't fit."""
    return epoch_seconds(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(date_pattern(strftime))), zone))


def time_of_day(t: Column) -> Column:
    """Seconds since midnight."""
    return epoch_seconds(t) % 86400.0


def time_text(seconds: Column, strftime: str = "%H:%M:%S") -> Column:
    return date_text(seconds, strftime)


def to_base16(x: Column) -> Column:
    return F.lower(F.hex(x.cast("binary")))


def from_base16(x: Column) -> Column:
    return F.unhex(x).cast("string")


def to_base64(x: Column) -> Column:
    return F.base64(x.cast("binary"))


def from_base64(x: Column) -> Column:
    return F.unbase64(x).cast("string")


def pack_number(x: Column, kind: str, big_endian: bool = False) -> Column:
    """A number as the bytes of a packed format; whole numbers wrap around."""
    code = (">" if big_endian else "<") + PACKED[kind]
    bits = 8 * struct.calcsize(code)

    @F.pandas_udf("binary")
    def pack(values):
        import pandas as pd

        def one(v):
            if v is None or v != v:
                return None
            if kind in ("float", "double"):
                return struct.pack(code, v)
            n = int(v) & ((1 << bits) - 1)
            return struct.pack(code, n - (1 << bits) if code[-1].islower() and n >> (bits - 1) else n)

        return pd.Series([one(v) for v in values])

    return pack(clean(x))


def unpack_number(x: Column, kind: str, big_endian: bool = False) -> Column:
    code = (">" if big_endian else "<") + PACKED[kind]

    @F.pandas_udf("double")
    def unpack(values):
        import pandas as pd

        size = struct.calcsize(code)
        return pd.Series([float(struct.unpack(code, bytes(v)[:size])[0]) if v is not None and len(v) >= size else None for v in values])

    return unpack(x)


def to_json(x: Column) -> Column:
    return F.to_json(x)


def from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def json_value(text: Column, path: str, kind: str = "string") -> Column:
    """A value at a JSON path, null if there is none or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def _yaml_scalar(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return json.dumps(x)
    return x if x and x.replace("_", "a").replace(" ", "a").isalnum() and not x[0].isdigit() and x not in ("null", "true", "false") and x == x.strip() else json.dumps(x, ensure_ascii=False)


def yaml_text(x, depth: int = 0) -> str:
    """Block YAML of maps, lists and simple values; keys in order."""
    pad = "  " * depth
    if isinstance(x, dict) and x:
        return "".join(f"{pad}{_yaml_scalar(k)}:" + (f"\n{yaml_text(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {yaml_text(v).strip() or _yaml_scalar(v)}\n") for k, v in x.items())
    if isinstance(x, list) and x:
        return "".join(f"{pad}- {yaml_text(v, depth + 1).strip()}\n" for v in x)
    return f"{pad}{'{}' if isinstance(x, dict) else '[]' if isinstance(x, list) else _yaml_scalar(x)}\n"


@F.udf(T.StringType())
def json_to_yaml(text: str | None) -> str | None:
    try:
        return None if text is None else yaml_text(json.loads(text))
    except ValueError:
        return None



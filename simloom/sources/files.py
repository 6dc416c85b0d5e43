"""Files: headerless CSV with typed fields, JSON, YAML, Parquet and raw bytes."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import json_to_yaml


def read_csv(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """Headerless CSV: columns c0, c1, ...; a field is a number if all of it parses as one, null if it is empty."""
    own = {"schema": ", ".join(f"c{i} string" for i in range(columns))} if columns else {"inferSchema": True}
    df = spark.read.options(header=False, escape='"', nullValue="", multiLine=True).csv(path, **own)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes only where needed; quotes inside are doubled."""
    df.write.mode("overwrite").options(header=False, escape='"', emptyValue="", nullValue="").csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, whole: bool = True) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=whole)


def write_json(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode("overwrite").json(path)


def parse_yaml(text: str) -> Any:
    """Block YAML as yaml_text() writes it: maps, lists and simple values by indentation, JSON for quoted scalars."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def scalar(s: str) -> Any:
        try:
            return json.loads(s)
        except ValueError:
            return None if s in ("", "~") else s

    def key(s: str) -> tuple[str, str] | None:
        if s.startswith('"'):
            k, end = json.JSONDecoder().raw_decode(s)
            return (k, s[end + 1 :].strip()) if s[end : end + 1] == ":" else None
        k, colon, rest = s.partition(":")
        return (k, rest.strip()) if colon and (not rest or rest[0] == " ") else None

    def block(i: int, depth: int) -> tuple[Any, int]:
        if lines[i][1].startswith("- "):
            out: Any = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1].startswith("- "):
                inner = lines[i][1][2:].strip()
                if inner.startswith("- ") or key(inner):
                    lines[i] = (depth + 2, inner)
                    x, i = block(i, depth + 2)
                else:
                    x, i = scalar(inner), i + 1
                out.append(x)
            return out, i
        if key(lines[i][1]) is None:
            return scalar(lines[i][1]), i + 1
        out = {}
        while i < len(lines) and lines[i][0] == depth and (kv := key(lines[i][1])):
            i += 1
            if kv[1]:
                out[kv[0]] = scalar(kv[1])
            elif i < len(lines) and lines[i][0] > depth:
                out[kv[0]], i = block(i, lines[i][0])
            else:
                out[kv[0]] = None
        return out, i

    return block(0, lines[0][0])[0] if lines else None


@F.udf(T.StringType())
def yaml_to_json(text: str | None) -> str | None:
    return None if text is None else json.dumps(parse_yaml(text))


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One YAML document a file, as the given fields."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json(yaml_to_json("value"), schema).alias("d")).select("d.*")


def write_yaml(df: DataFrame, path: str) -> None:
    """One YAML document a row, parted by lines of three dashes."""
    df.select(json_to_yaml(F.to_json(F.struct(*df.columns))).alias("value")).write.mode("overwrite").option("lineSep", "---\n").text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files of any kind."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def store_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writers = {"csv": write_csv, "json": write_json, "yaml": write_yaml}
    writers[kind](df, path) if kind in writers else df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    readers = {"csv": read_csv, "json": read_json, "yaml": read_yaml, "bytes": read_bytes}
    return readers[kind](spark, path, **options) if kind in readers else spark.read.parquet(path)

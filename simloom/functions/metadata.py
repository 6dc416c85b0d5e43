"""Annotations and comments of labels, kept in the columns' metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_note(df: DataFrame, label: str, text: str, kind: str = "comment") -> DataFrame:
    """kind: comment or annotation."""
    return df.withMetadata(label, {**df.schema[label].metadata, kind: text})


def get_note(df: DataFrame, label: str, kind: str = "comment") -> str | None:
    return df.schema[label].metadata.get(kind)


def notes(df: DataFrame, kind: str = "comment") -> dict[str, str]:
    """The notes of all labels that have one."""
    return {f.name: f.metadata[kind] for f in df.schema.fields if kind in f.metadata}


def get_value(df: DataFrame, label: str) -> DataFrame:
    """The label without its metadata."""
    return df.select(F.col(label).alias(label, metadata={}))


def set_value(df: DataFrame, label: str, value) -> DataFrame:
    """A new value under the old metadata."""
    return df.withColumn(label, value).withMetadata(label, df.schema[label].metadata)

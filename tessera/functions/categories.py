"""Categoricals: strings whose ordered categories stand in the column's metadata, which Parquet keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def categories(df: DataFrame, column: str) -> list[str] | None:
    return df.schema[column].metadata.get("categories")


def with_categories(df: DataFrame, column: str, values: list[str], ordered: bool = False) -> DataFrame:
    return df.withMetadata(column, {**df.schema[column].metadata, "categories": list(values), "ordered": ordered})


def as_category(df: DataFrame, column: str) -> DataFrame:
    """The column as a categorical of its sorted distinct values (category lists are small by nature)."""
    found = [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().sort(column).collect()]
    return with_categories(df.withColumn(column, F.col(column).cast("string")), column, found)


def union_categories(lists: list[list[str]]) -> list[str]:
    """All categories in the order of their first appearance."""
    return list(dict.fromkeys(c for one in lists for c in one))


def encode(column: str | Column, values: list[str]) -> Column:
    """0-based code; null for null and for values that are no category."""
    col = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), col), F.lit(0)).cast("int") - 1


def decode(code: str | Column, values: list[str]) -> Column:
    col = F.col(code) if isinstance(code, str) else code
    return F.get(F.array(*map(F.lit, values)).cast("array<string>"), col)


def sort_keys(df: DataFrame, columns: list[str]) -> list[Column]:
    """Ascending sort keys, nulls and NaN last; categoricals by the order of their categories."""
    out: list[Column] = []
    for c in columns:
        known = categories(df, c)
        col = encode(c, known) if known else F.col(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(c), F.col(c))
        out.append(col.asc_nulls_last())
    return out

"""Size strings, rounding and the row counts of storage chunks and shards. Plain driver arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40, "P": 1 << 50}
_WIDTHS = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8}


def parse_size(size: int | str) -> int:
    """Bytes of a size such as ``"20GB"``, ``"1.5 MiB"`` or ``512``; units are binary."""
    if isinstance(size, int):
        return size
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([A-Za-z]*)\s*", size)
    unit = re.sub(r"(?i)(i?b|bytes?)$", "", m[2]).upper() if m else None
    if unit not in _UNITS:
        raise ValueError(f"not a size: {size!r}")
    return int(float(m[1]) * _UNITS[unit])


def round_down(num: int, divisor: int) -> int:
    return num - num % divisor


def rows_of(size: int | str, bytes_per_row: float) -> int:
    """Rows that fill a size: a number is a number of rows already; at least 1."""
    return max(1, size) if isinstance(size, int) else max(1, int(parse_size(size) / max(bytes_per_row, 1e-9)))


def check_at_least_one(**values: int) -> None:
    for name, v in values.items():
        if v < 1:
            raise ValueError(f"{name} must be at least 1, not {v}")


def dense_layout(n_rows: int, n_obs_per_chunk: int, shard_rows: int) -> tuple[int, int]:
    """Rows of a chunk and of a shard, the latter a multiple of the former and one chunk at least."""
    chunk = min(n_obs_per_chunk, n_rows)
    if chunk == 0:
        raise ValueError("no rows to write")
    return chunk, max(chunk, round_down(min(shard_rows, n_rows), chunk))


def sparse_layout(n_rows: int, nnz: int, n_obs_per_chunk: int, shard_rows: int) -> tuple[int, int]:
    """The same in stored elements, by the mean number of elements of a row."""
    if n_rows == 0:
        raise ValueError("no rows to write")
    mean = nnz / n_rows
    chunk = max(1, min(int(n_obs_per_chunk * mean), nnz))
    return chunk, max(chunk, round_down(max(1, min(int(shard_rows * mean), nnz)), chunk))


def width(kind: T.DataType) -> int | None:
    """Bytes of a value of fixed width; categories and other strings count as a 4-byte code; None if nested."""
    if isinstance(kind, T.DecimalType):
        return 16
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 4
    return _WIDTHS.get(type(kind))


def _bytes(col: F.Column, kind: T.DataType) -> F.Column:
    own = width(kind)
    if own is not None:
        return F.lit(own)
    if isinstance(kind, T.ArrayType):
        each = width(kind.elementType)
        if each is not None:
            return F.coalesce(F.size(col), F.lit(0)) * each
        return F.coalesce(F.aggregate(F.transform(col, lambda x: _bytes(x, kind.elementType).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    if isinstance(kind, T.StructType):
        out = F.lit(0)
        for f in kind.fields:
            out = out + _bytes(col[f.name], f.dataType)
        return out
    raise ValueError(f"no size estimate for {kind.simpleString()}")


def bytes_per_row(rows: DataFrame, columns: list[str] | None = None) -> float:
    """Mean uncompressed bytes of a row, in one pass over the arrays' lengths. A sparse row also holds an 8-byte row pointer."""
    fields = [f for f in rows.schema.fields if columns is None or f.name in columns]
    total = F.lit(0).cast("long")
    for f in fields:
        total = total + _bytes(F.col(f"`{f.name}`"), f.dataType)
        if isinstance(f.dataType, T.StructType) and set(f.dataType.names) == {"indices", "values"}:
            total = total + 8
    return float(rows.agg(F.avg(total)).first()[0] or 0.0)

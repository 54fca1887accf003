"""Scalars: zero values, bytes, text forms, hashes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero(kind: T.DataType) -> Column:
    """The zero value of a type: 0, false, empty, the epoch; groups field by field."""
    if isinstance(kind, T.StructType):
        return F.struct(*[(F.lit(None).cast(f.dataType) if f.nullable else zero(f.dataType)).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.DateType):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(kind)
    if isinstance(kind, T.NullType):
        return F.lit(None)
    return F.lit(0).cast(kind)


def null_if_zero(c: Column, kind: T.DataType) -> Column:
    """Null where a value is its type's zero, as optional columns store it."""
    return F.when(c.eqNullSafe(zero(kind)), F.lit(None).cast(kind)).otherwise(c)


def text(c: Column) -> Column:
    """The display form; null is <null>."""
    return F.coalesce(c.cast("string"), F.lit("<null>"))


def _reverse_hex(h: Column, n: int) -> Column:
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])


def little_endian(c: Column, kind: T.DataType) -> Column:
    """The bytes of a number, lowest first; one byte for a boolean; text and bytes as they are."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit(b"\x01")).when(~c, F.lit(b"\x00"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return c.cast("binary")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        size, code = (4, "<f") if isinstance(kind, T.FloatType) else (8, "<d")

        @F.pandas_udf("binary")
        def packed(s: pd.Series) -> pd.Series:
            return s.map(lambda x: struct.pack(code, x), na_action="ignore")

        return packed(c)
    n = {"byte": 1, "short": 2, "integer": 4, "long": 8}[kind.typeName()]
    width = max(n, 4)
    return F.unhex(_reverse_hex(F.lpad(F.when(c.isNotNull(), F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * width))), 2 * width, "0"), width))


def _parse(data: bytes, kind: str):
    sizes = {"boolean": 1, "int32": 4, "int64": 8, "int96": 12, "float": 4, "double": 8}
    if kind in sizes and len(data) != sizes[kind]:
        raise ValueError(f"a {kind} has {sizes[kind]} bytes, not {len(data)}")
    if kind == "boolean":
        return data != b"\x00"
    if kind in ("int32", "int64", "int96"):
        return int.from_bytes(data, "little", signed=True)
    return struct.unpack("<f" if kind == "float" else "<d", data)[0] if kind in sizes else data


def parse_value(data: bytes | None, kind: str):
    """The value whose plain bytes these are; the length is checked."""
    return None if data is None else _parse(data, kind)


def xxh64(c: Column) -> Column:
    """xxHash64 with seed 0 of a binary column, as a signed long."""

    @F.pandas_udf("long")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for s in parts:
            yield s.map(lambda b: (h := xxhash.xxh64_intdigest(bytes(b))) - (1 << 64 if h >> 63 else 0), na_action="ignore")

    return digest(c)


def count_byte(c: Column, value: int) -> Column:
    """How often a byte occurs in a binary column; one pass over characters that stand for bytes."""
    characters = F.decode(c, "ISO-8859-1")
    return F.length(characters) - F.length(F.replace(characters, F.lit(chr(value)), F.lit("")))

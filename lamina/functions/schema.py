"""Schemas: a small column language, equality, lookup by path and the Parquet message text."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Names of the column language and their types.
TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "int96": T.DecimalType(29, 0),
    "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "enum": T.StringType(), "json": T.StringType(),
    "uuid": T.BinaryType(), "bson": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamp_utc": T.TimestampType(), "time": T.LongType(), "null": T.NullType(),
}
# The primitive and annotation that the message text gives each Spark type.
MESSAGE = {
    "boolean": ("boolean", ""), "byte": ("int32", "INT(8,true)"), "short": ("int32", "INT(16,true)"), "integer": ("int32", "INT(32,true)"), "long": ("int64", "INT(64,true)"),
    "float": ("float", ""), "double": ("double", ""), "binary": ("binary", ""), "string": ("binary", "STRING"), "date": ("int32", "DATE"),
    "timestamp": ("int64", "TIMESTAMP(isAdjustedToUTC=true,unit=MICROS)"), "timestamp_ntz": ("int64", "TIMESTAMP(isAdjustedToUTC=false,unit=MICROS)"), "void": ("int32", "NULL"),
}
SCALARS = {"json", "uuid", "enum", "bson", "time", "uint8", "uint16", "uint32", "uint64", "int96"}


def column(name: str, spec: str | T.DataType, **metadata) -> T.StructField:
    """A field from words: a type, then any of optional, repeated, list, delta, dict, plain, split
    and codec names (kept as metadata); decimal(scale:precision), fixed(n) and map(k,v) too."""
    if isinstance(spec, T.DataType):
        return T.StructField(name, spec, False, metadata)
    words = spec.split()
    head, flags = words[0], words[1:]
    if len(set(flags)) != len(flags):
        raise ValueError(f"{name}: a word is given twice in {spec!r}")
    if m := re.fullmatch(r"decimal\((\d+):(\d+)\)", head):
        kind: T.DataType = T.DecimalType(int(m[2]), int(m[1]))
    elif m := re.fullmatch(r"fixed\((\d+)\)", head):
        kind, metadata = T.BinaryType(), metadata | {"length": int(m[1])}
    elif m := re.fullmatch(r"map\((\w+),(\w+)\)", head):
        kind = T.MapType(TYPES[m[1]], TYPES[m[2]])
    elif head in TYPES:
        kind = TYPES[head]
    else:
        raise ValueError(f"{name}: unknown type {head!r}")
    known = {"optional", "repeated", "list", "dict", "plain", "delta", "split", "snappy", "gzip", "brotli", "lz4", "zstd", "uncompressed"}
    if bad := [f for f in flags if f not in known]:
        raise ValueError(f"{name}: unknown words {bad}")
    if head in SCALARS:
        metadata = metadata | {"logical": head}
    if rest := [f for f in flags if f not in ("optional", "repeated", "list")]:
        metadata = metadata | {"storage": rest}
    if "repeated" in flags or "list" in flags:  # the items of an optional list are optional
        kind = T.ArrayType(kind, "optional" in flags)
        return T.StructField(name, kind, False, metadata)
    return T.StructField(name, kind, "optional" in flags, metadata)


def schema(*columns: T.StructField, **specs: str) -> T.StructType:
    return T.StructType([*columns, *(column(k, v) for k, v in specs.items())])


def schemas_equal(a: T.DataType, b: T.DataType, nullability: bool = True) -> bool:
    """Equal names in the same order, types and repetition; storage metadata doesn't count."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        same = lambda x, y: x.name == y.name and (not nullability or x.nullable == y.nullable) and x.metadata.get("logical") == y.metadata.get("logical") and x.metadata.get("length") == y.metadata.get("length") and schemas_equal(x.dataType, y.dataType, nullability)
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return (not nullability or a.containsNull == b.containsNull) and schemas_equal(a.elementType, b.elementType, nullability)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return schemas_equal(a.keyType, b.keyType, nullability) and schemas_equal(a.valueType, b.valueType, nullability)
    return a == b


def lookup(of: T.StructType, *path: str) -> T.StructField | None:
    """The leaf field at a path, through lists; None if there is none."""
    field = None
    kind: T.DataType = of
    for name in path:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        field = kind[name]
        kind = field.dataType
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return None if isinstance(kind, T.StructType) else field


def leaves(of: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The paths of all leaf columns, in order."""
    out = []
    for f in of:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        out += leaves(kind, (*prefix, f.name)) if isinstance(kind, T.StructType) else [(*prefix, f.name)]
    return out


def decimal_bytes(precision: int) -> int:
    """The least number of bytes that hold a signed decimal of this precision."""
    n = 1
    while 1 << (8 * n - 1) < 10**precision:
        n += 1
    return n


def message(of: T.StructType, name: str = "schema", indent: str = "    ") -> str:
    """The schema as a Parquet message."""

    def field(f: T.StructField, depth: int, repetition: str | None = None) -> list[str]:
        pad, kind = indent * depth, f.dataType
        rep = repetition or ("optional" if f.nullable else "required")
        if isinstance(kind, T.StructType):
            return [f"{pad}{rep} group {f.name} {{", *(x for g in kind for x in field(g, depth + 1)), f"{pad}}}"]
        if isinstance(kind, T.ArrayType):
            inner = field(T.StructField("element", kind.elementType, kind.containsNull), depth + 2)
            return [f"{pad}{rep} group {f.name} (LIST) {{", f"{pad}{indent}repeated group list {{", *inner, f"{pad}{indent}}}", f"{pad}}}"]
        if isinstance(kind, T.MapType):
            inner = [*field(T.StructField("key", kind.keyType, False), depth + 2), *field(T.StructField("value", kind.valueType, kind.valueContainsNull), depth + 2)]
            return [f"{pad}{rep} group {f.name} (MAP) {{", f"{pad}{indent}repeated group key_value {{", *inner, f"{pad}{indent}}}", f"{pad}}}"]
        if isinstance(kind, T.DecimalType):
            physical = "int32" if kind.precision <= 9 else "int64" if kind.precision <= 18 else f"fixed_len_byte_array({decimal_bytes(kind.precision)})"
            note = f"DECIMAL({kind.precision},{kind.scale})"
        else:
            physical, note = MESSAGE[kind.typeName()]
        return [f"{pad}{rep} {physical} {f.name}{f' ({note})' if note else ''};"]

    return "\n".join([f"message {name} {{", *(x for f in of for x in field(f, 1)), "}"])

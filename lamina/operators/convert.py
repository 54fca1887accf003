"""Conversion of tables between schemas, columns matched by path.

  missing column          zero if required, null if optional, empty if repeated
  extra column            left out
  required -> optional    as it is; optional -> required: null becomes zero
  scalar -> repeated      a list of one, null becomes an empty list
  repeated -> scalar      the first element, null (or zero) if there is none
  groups                  field by field; a null group of a required group is all zeros
  lists of groups         element by element, missing fields as above
  other types             the cast table of lamina.functions.casts
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.casts import cast
from lamina.functions.values import zero


class ConvertError(ValueError):
    """There is no conversion between two column types."""


def _convert(c: Column, have: T.DataType, want: T.DataType, nullable: bool) -> Column:
    if isinstance(want, T.ArrayType):
        if isinstance(have, T.ArrayType):
            if have.elementType == want.elementType:
                out = c
            else:
                out = F.transform(c, lambda x: _convert(x, have.elementType, want.elementType, want.containsNull))
            return out if nullable else F.coalesce(out, F.array().cast(want))
        one = _convert(c, have, want.elementType, True)
        return F.when(c.isNull(), F.array().cast(want)).otherwise(F.array(one))
    if isinstance(have, T.ArrayType):
        return _convert(F.get(c, F.lit(0)), have.elementType, want, nullable)
    if isinstance(want, T.StructType):
        if not isinstance(have, T.StructType):
            raise ConvertError(f"{have.simpleString()} can't be converted to {want.simpleString()}")
        inner = F.struct(*[_field(c, have, f).alias(f.name) for f in want])
        return F.when(c.isNotNull(), inner) if nullable else inner
    if isinstance(have, T.StructType):
        raise ConvertError(f"{have.simpleString()} can't be converted to {want.simpleString()}")
    out = c if have == want else cast(c, have, want)
    return out if nullable else F.coalesce(out, zero(want))


def _field(parent: Column | None, have: T.StructType, f: T.StructField) -> Column:
    if f.name in have.names:
        c = F.col(f"`{f.name}`") if parent is None else parent[f.name]
        return _convert(c, have[f.name].dataType, f.dataType, f.nullable)
    if f.nullable:
        return F.lit(None).cast(f.dataType)
    return zero(f.dataType)


def convert(df: DataFrame, to: T.StructType) -> DataFrame:
    """df with the columns and types of `to`; one projection, so unused columns aren't read."""
    return df.select(*[_field(None, df.schema, f).alias(f.name) for f in to])


def surviving_keys(keys: list, to: T.StructType) -> list:
    """The longest prefix of sort keys whose columns `to` still has."""
    out = []
    for k in keys:
        if k.path.split(".")[0] not in to.names:
            break
        out.append(k)
    return out

"""Concatenation and ordered merges of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamina.functions.schema import schemas_equal
from lamina.operators.convert import convert
from lamina.operators.sort import Key, expressions, has_prefix, with_position


def concat(tables: Sequence[DataFrame], target: StructType | None = None) -> DataFrame:
    """All rows of all tables. Schemas must be equal, or every table is converted to `target`."""
    if not tables:
        raise ValueError("nothing to merge")
    if target is not None:
        tables = [convert(t, target) for t in tables]
    elif any(not schemas_equal(tables[0].schema, t.schema, nullability=False) for t in tables[1:]):
        raise ValueError("the schemas differ; give a target")
    return reduce(DataFrame.unionByName, tables)


def merge(tables: Sequence[DataFrame], keys: Sequence[Key], target: StructType | None = None, sorted_by: Sequence[Sequence[Key]] | None = None, ordinal: str | None = None) -> DataFrame:
    """One table in order. Each input's own keys, where given, must begin with `keys`; ties go by
    the input's number if `ordinal` names a column for it."""
    if sorted_by is not None and any(not has_prefix(own, keys) for own in sorted_by):
        raise ValueError("the merge keys are no prefix of an input's keys")
    if ordinal:
        tables = [t.withColumn(ordinal, F.lit(i)) for i, t in enumerate(tables)]
        keys = [*keys, Key(ordinal)]
    out = concat(tables, target)
    return out.orderBy(*expressions(out, keys)) if keys else out


def merge_positions(tables: Sequence[DataFrame], keys: Sequence[Key], ordinal: str | None = None) -> DataFrame:
    """A merge as positions: every row with its place `pos` in the merged order."""
    if ordinal:
        tables = [t.withColumn(ordinal, F.lit(i)) for i, t in enumerate(tables)]
        keys = [*keys, Key(ordinal)]
    return with_position(concat(tables), keys, "pos")

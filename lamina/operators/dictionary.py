"""Dictionaries: distinct values numbered in the order in which they are first seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.sort import Key, fresh, with_position


def dictionary(df: DataFrame, column: str, keys: Sequence[Key]) -> DataFrame:
    """(code, value) of a column without nulls; code 0 is the value seen first.

    The first place of each value is an aggregate; only distinct values are numbered."""
    some = df.where(F.col(column).isNotNull())
    if any(k.descending or k.nulls_first for k in keys):
        pos = fresh(df, "_pos")[0]
        some, place = with_position(some, keys, pos), F.col(pos)
    else:
        place = F.struct(*[x for k in keys for x in (F.col(k.path).isNull(), F.col(k.path))])
    first = some.groupBy(F.col(column).alias("value")).agg(F.min(place).alias("first"))
    return with_position(first, [Key("first")], "code").select("code", "value")


def encode(df: DataFrame, column: str, of: DataFrame, name: str = "code") -> DataFrame:
    """df with the code of each value; null where the value is null or not in the dictionary."""
    value = fresh(df, "_value")[0]
    return df.join(of.select(F.col("code").alias(name), F.col("value").alias(value)), F.col(column) == F.col(value), "left").drop(value)


def decode(df: DataFrame, of: DataFrame, code: str = "code", name: str = "value") -> DataFrame:
    """df with the value of each code."""
    own = fresh(df, "_code")[0]
    return df.join(of.select(F.col("code").alias(own), F.col("value").alias(name)), F.col(code) == F.col(own), "left").drop(own)


def value_at(of: DataFrame, code: int) -> DataFrame:
    return of.where(F.col("code") == code).select("value")


def bounds(df: DataFrame, of: DataFrame, code: str = "code") -> DataFrame:
    """The least and greatest value among the codes of df."""
    used = df.select(F.col(code).alias("code")).distinct()
    return of.join(used, "code", "left_semi").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def probe(of: DataFrame, values: DataFrame, keys: Sequence[Key], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Look up or insert: the rows of `values` with the code of their value (null for a null) and whether
    it is new, and the dictionary with the new values, which are numbered on in the order in which
    they are first seen. Codes that were given stay."""
    new = dictionary(values.join(of.select(F.col("value").alias(column)), column, "left_anti"), column, keys)
    n = of.agg(F.coalesce(F.max("code") + 1, F.lit(0)).cast("bigint").alias("_next"))
    grown = of.select("code", "value", F.lit(False).alias("is_new")).unionByName(new.join(F.broadcast(n)).select((F.col("code") + F.col("_next")).alias("code"), "value", F.lit(True).alias("is_new")))
    own, flag = fresh(values, "_code", "_is_new")
    coded = values.join(grown.select(F.col("code").alias(own), F.col("value").alias(column), F.col("is_new").alias(flag)), column, "left")
    return coded.select(*values.columns, F.col(own).alias("code"), F.col(flag).alias("is_new")), grown.drop("is_new")

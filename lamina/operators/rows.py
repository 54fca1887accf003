"""Row operators: filter, scan-while, transform, consecutive de-duplication, slices, row building."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamina.operators.sort import Key, fresh, limit, with_position, with_previous


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """The rows where predicate is true. Expressions are pushed into the scan; a function of a pandas
    batch is the way for predicates that no expression can say."""
    if not callable(predicate) or isinstance(predicate, Column):
        return df.where(predicate)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[predicate(f).astype(bool)]

    return df.mapInPandas(run, df.schema)


def scan_while(df: DataFrame, predicate: Column, keys: Sequence[Key]) -> DataFrame:
    """The rows before the first one, in the order of the keys, where predicate isn't true.

    No sort: the first failing row is one aggregate, and the rows before it are a filter."""
    fails = df.where(~F.coalesce(predicate, F.lit(False)))
    pos, last = fresh(df, "_pos", "_stop")
    if all(not k.descending and not k.nulls_first for k in keys):
        place = lambda: F.struct(*[x for k in keys for x in (F.col(k.path).isNull(), F.col(k.path))])
        stop = fails.agg(F.min(place()).alias(last))
        return df.join(F.broadcast(stop), (place() < F.col(last)) | F.col(last).isNull()).drop(last)
    placed = with_position(df, keys, pos)
    stop = placed.where(~F.coalesce(predicate, F.lit(False))).agg(F.min(pos).alias(last))
    return placed.join(F.broadcast(stop), (F.col(pos) < F.col(last)) | F.col(last).isNull()).drop(pos, last)


def scan_while_index(df: DataFrame, n: int, keys: Sequence[Key]) -> DataFrame:
    """scan_while for a predicate on the position alone: the first n rows."""
    return limit(df, n, keys)


def transform(df: DataFrame, columns: dict[str, Column] | Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str | None = None, skip: Column | None = None) -> DataFrame:
    """Each row mapped to another; rows where `skip` is true are left out. A function of a pandas
    batch (with its schema) may return any number of rows."""
    if isinstance(columns, dict):
        kept = df if skip is None else df.where(~F.coalesce(skip, F.lit(False)))
        return kept.select(*[c.alias(k) for k, c in columns.items()])
    fn = columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield fn(f)

    return df.mapInPandas(run, schema)


def dedupe_consecutive(df: DataFrame, on: Sequence[str], keys: Sequence[Key]) -> DataFrame:
    """Drops rows that equal the row before them in the columns `on`; adds pos, the place in the input."""
    prefix = "_prev_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    with_prev = with_previous(df, keys, list(on), prefix, "pos")
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return with_prev.where((F.col("pos") == 0) | ~same).select(*df.columns, "pos")


def seek(df: DataFrame, k: int, keys: Sequence[Key]) -> DataFrame:
    """Rows from position k on, with pos; later operators see the order only through it."""
    return with_position(df, keys, "pos").where(F.col("pos") >= k)


def page_slice(df: DataFrame, i: int, j: int, keys: Sequence[Key]) -> DataFrame:
    """Rows at positions i to j - 1, with pos."""
    return with_position(df, keys, "pos").where((F.col("pos") >= i) & (F.col("pos") < j))


def null_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column, whether it is null."""
    return df.select("*", *[F.col(c).isNull().alias(f"{c}_is_null") for c in columns])


def build_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str = "rows") -> DataFrame:
    """One nested row for each group: a list of structs, in order."""
    entry = F.struct(*order, *[f for f in fields if f not in order])
    pick = lambda x: F.struct(*[x[f].alias(f) for f in fields])
    return df.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(entry)), pick).alias(name))


def flatten_rows(df: DataFrame, group: Sequence[str], name: str = "rows") -> DataFrame:
    """The elements of a nested list as rows again, with their place."""
    return df.select(*group, F.posexplode(name).alias("_at", "_e")).select(*group, F.col("_at").cast("bigint").alias("at"), "_e.*")


def rows_equal(a: Sequence[str], b: Sequence[str]) -> Column:
    """Whether two lists of columns hold the same row (nulls are equal)."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object; null fields are there as null."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))

"""Writers of Parquet data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.schema import schemas_equal
from lamina.operators.sort import Key, dedupe_sorted, expressions, leading

CODECS = ("uncompressed", "snappy", "gzip", "zstd", "lz4_raw")


def write(df: DataFrame, path: str, *, mode: str = "errorifexists", codec: str = "uncompressed", page_size: int | None = None, row_group_size: int | None = None, max_rows_per_file: int | None = None, index_truncate: int | None = 16, version: int = 1, bloom: dict[str, int] | None = None, plain: Sequence[str] = (), sort_by: Sequence[Key] = (), single_file: bool = False) -> None:
    """Write a table. bloom: column -> expected distinct values; plain: columns without dictionary;
    sort_by: order inside each file. Version 2 pages hold delta-coded text, which Spark's vectorised
    reader misreads without compression, so version 1 is the default."""
    if codec not in CODECS:
        raise ValueError(f"codec {codec}: one of {', '.join(CODECS)} is needed")
    if single_file:
        df = df.coalesce(1)
    if sort_by:
        df = df.sortWithinPartitions(*expressions(df, sort_by))
    out = df.write.mode(mode).option("compression", codec).option("parquet.writer.version", f"PARQUET_{version}_0")
    options = {"parquet.page.size": page_size, "parquet.block.size": row_group_size, "maxRecordsPerFile": max_rows_per_file, "parquet.columnindex.truncate.length": index_truncate}
    for c, n in (bloom or {}).items():
        options |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": n}
    for c in plain:
        options[f"parquet.enable.dictionary#{c}"] = "false"
    for k, v in options.items():
        if v is not None:
            out = out.option(k, v)
    out.parquet(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[Key], *, drop_duplicates: bool = False, tie_break: Sequence[Key] = (), **options) -> None:
    """External sort into range-partitioned files whose concatenation is in order; with
    drop_duplicates the first row (by tie_break) of equal keys stays."""
    if not keys:
        raise ValueError("a sorting writer needs sorting columns")
    if drop_duplicates:
        df = dedupe_sorted(df, keys, tie_break)
    by = expressions(df, [*keys, *tie_break])
    write(df.repartitionByRange(*leading(df, keys)).sortWithinPartitions(*by), path, **options)


def append(df: DataFrame, path: str, **options) -> None:
    """Add a table of the same schema to the files of `path`."""
    there = df.sparkSession.read.parquet(path).schema
    if not schemas_equal(there, df.schema, nullability=False):
        raise ValueError("the schemas differ")
    write(df, path, mode="append", **options)


def tee(df: DataFrame, paths: Sequence[str], **options) -> None:
    """Write one table to several paths; it is computed once. The first failure ends it."""
    kept = df.persist()
    try:
        for p in paths:
            write(kept, p, **options)
    finally:
        kept.unpersist()


def copy(df: DataFrame, path: str, target=None, **options) -> int:
    """Write df, converted to the schema `target` if there is one; the number of rows written."""
    from lamina.operators.convert import convert

    write(convert(df, target) if target is not None else df, path, **options)
    return df.sparkSession.read.parquet(path).count()


def with_metadata(df: DataFrame, pairs: dict[str, str], column: str | None = None) -> DataFrame:
    """Key/value metadata kept with the schema that Spark writes to the footers (on a column)."""
    name = column or df.columns[0]
    return df.withMetadata(name, df.schema[name].metadata | {"kv": dict(sorted(pairs.items()))})


def metadata_of(df: DataFrame, key: str, column: str | None = None) -> str | None:
    """The value of a metadata key, as written by with_metadata; None if it is not there."""
    return df.schema[column or df.columns[0]].metadata.get("kv", {}).get(key)


def bounded_by_rows(df: DataFrame, n: int) -> DataFrame:
    """Rows tagged with the output group of at most n rows that they fall into, inside a partition."""
    return df.withColumn("_group", F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / n))

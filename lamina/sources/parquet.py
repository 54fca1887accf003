"""Scans of Parquet data: whole tables, projections, offsets, footers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None, columns: Sequence[str] | None = None, *, verify_checksums: bool = False, column_index: bool = True, bloom_filters: bool = True, merge_schema: bool = False) -> DataFrame:
    """A table from one or more Parquet paths. `schema` is the caller's view of it: its columns are
    read, others are pruned, and columns that the files lack are null. `columns` only prunes."""
    reader = spark.read.option("mergeSchema", merge_schema).option("parquet.filter.columnindex.enabled", column_index).option("parquet.filter.bloom.enabled", bloom_filters).option("parquet.page.verify-checksum.enabled", verify_checksums)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """The empty relation of a schema."""
    return spark.createDataFrame([], schema)


def concat(spark: SparkSession, paths: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """The rows of all files, one scan."""
    return read(spark, list(paths), schema)


def row_count(df: DataFrame) -> DataFrame:
    """One row: n_rows. No column is read where the footers have the count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def column(df: DataFrame, path: str, name: str = "value") -> DataFrame:
    """One leaf column by its path; the elements of repeated columns one by one, where a null or
    empty list counts as one null value."""
    c = F.col(path)
    kind = df.select(c).schema[0].dataType.typeName()
    return df.select(F.explode_outer(c).alias(name)) if kind == "array" else df.select(c.alias(name))


def rows(df: DataFrame, batch: int | None = None) -> Iterator:
    """Rows pulled one by one (or in lists of `batch`), one partition in memory at a time."""
    if batch is None:
        yield from df.toLocalIterator()
        return
    held = []
    for r in df.toLocalIterator():
        held.append(r)
        if len(held) == batch:
            yield held
            held = []
    if held:
        yield held


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Adds each row's position in its own file."""
    return df.select("*", F.col("_metadata.row_index").alias(name))


def seek_in_file(df: DataFrame, row: int) -> DataFrame:
    """Rows from position `row` of each file on; row groups before it are skipped by the scan."""
    return df.where(F.col("_metadata.row_index") >= row)


def files(df: DataFrame) -> DataFrame:
    """The row-group blocks that a scan reads: file, start, length, rows."""
    m = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.col("_metadata.file_block_length").alias("block_length"))
    return m.groupBy("file", "block_start", "block_length").agg(F.count(F.lit(1)).alias("n_rows"))


def read_as(spark: SparkSession, path: str | Sequence[str], schema: StructType, **options) -> DataFrame:
    """A table read with its own types and converted to the schema: by path, with casts, missing columns
    as null or zero, and others left out."""
    from lamina.operators.convert import convert

    return convert(read(spark, path, **options), schema)


def _metadata(spark: SparkSession, path: str, rows_of: Callable[[str, object], list[tuple]], schema: str) -> DataFrame:
    """rows_of(file, footer) for each Parquet file below path. Executors open the files and read their
    ends; whole files are read only from a store that none but Spark can open."""
    import pandas as pd

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    names = [c.split()[0] for c in schema.split(", ")]

    def opened(name: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(name)
        return system.open_input_file(at)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pyarrow.parquet as pq

        for frame in frames:
            for r in frame.itertuples(index=False):
                with opened(r.path) if whole is None else io.BytesIO(r.content) as f:
                    yield pd.DataFrame(rows_of(r.path, pq.ParquetFile(f).metadata), columns=names)

    whole = None
    first = found.select("path").head()
    if first is not None:
        try:
            opened(first.path).close()
        except (OSError, ValueError, NotImplementedError) as error:  # not a store that pyarrow knows
            whole = str(error)
    return found.select("path", *([] if whole is None else ["content"])).mapInPandas(of, schema)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per column chunk of every file under `path`: row group, column, codec, encodings,
    counts, sizes and bounds."""
    schema = "file string, row_group int, n_rows long, column string, physical string, codec string, encodings string, n_values long, n_nulls long, min string, max string, compressed long, uncompressed long"

    def chunks(name: str, meta) -> list[tuple]:
        out = []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                k = group.column(c)
                s = k.statistics
                bounds = (s.null_count, *(str(x) for x in (s.min, s.max))) if s is not None and s.has_min_max else (s.null_count if s is not None else None, None, None)
                out.append((name, g, group.num_rows, k.path_in_schema, k.physical_type, k.compression, ",".join(k.encodings), k.num_values, *bounds, k.total_compressed_size, k.total_uncompressed_size))
        return out

    return _metadata(spark, path, chunks, schema)


def key_values(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The key/value pairs (file, key, value) of the footers, whoever wrote them; of one key, if given."""
    pairs = lambda name, meta: [(name, k.decode(), v.decode(errors="replace")) for k, v in sorted((meta.metadata or {}).items())]
    out = _metadata(spark, path, pairs, "file string, key string, value string")
    return out if key is None else out.where(F.col("key") == key)


def row_group(spark: SparkSession, file: str, index: int) -> DataFrame:
    """The rows of one row group of one file."""
    sizes = _metadata(spark, file, lambda name, meta: [(g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)], "row_group int, n_rows long")
    counts = [r.n_rows for r in sizes.orderBy("row_group").collect()]
    if not 0 <= index < len(counts):
        raise IndexError(f"row group {index} of {len(counts)}")
    start = sum(counts[:index])
    at = F.col("_metadata.row_index")
    return read(spark, file).where((at >= start) & (at < start + counts[index]))

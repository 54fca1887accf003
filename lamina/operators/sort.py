"""Sort keys with explicit null placement, total orders, positions and previous rows.

Nulls come last in both directions unless a key says otherwise. A repeated column compares element
by element; an empty or null list counts as null. NaN is the highest number.

Positions are numbered without a single task: rows are range-partitioned by the keys, sorted inside
their partition, and written to the shared folder; a count per partition (as many rows as there are
partitions) gives each partition its first position."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


@dataclass(frozen=True)
class Key:
    path: str
    descending: bool = False
    nulls_first: bool = False


def ascending(path: str) -> Key:
    return Key(path)


def descending(path: str) -> Key:
    return Key(path, True)


def nulls_first(key: Key) -> Key:
    return Key(key.path, key.descending, True)


def _value(df: DataFrame, key: Key) -> Column:
    c = F.col(key.path)
    if isinstance(df.select(c).schema[0].dataType, ArrayType):
        return F.when(F.size(c) > 0, c)
    return c


def expressions(df: DataFrame, keys: Sequence[Key]) -> list[Column]:
    """The Spark sort expressions of the keys."""
    out = []
    for k in keys:
        c = _value(df, k)
        out.append({(0, 0): c.asc_nulls_last, (0, 1): c.asc_nulls_first, (1, 0): c.desc_nulls_last, (1, 1): c.desc_nulls_first}[k.descending, k.nulls_first]())
    return out


leading = expressions


def sort(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """All rows in order."""
    if not keys:
        raise ValueError("no sort keys")
    return df.orderBy(*expressions(df, keys))


def has_prefix(keys: Sequence[Key], prefix: Sequence[Key]) -> bool:
    return list(keys[: len(prefix)]) == list(prefix)


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a local folder only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get()
    return f"{base.rstrip('/')}/lamina/{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, or others like them, so that none is a column of df (Spark tells none apart by case)."""
    prefix, there = "", [c.lower() for c in df.columns]
    while any((prefix + n).lower() in there for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def _ranged(df: DataFrame, keys: Sequence[Key]) -> tuple[DataFrame, DataFrame, list[str]]:
    """df sorted and tagged with its partition and place there; the first position and the last row before
    each partition; the names of these columns (partition, place, first position, row before)."""
    spark, by = df.sparkSession, expressions(df, keys)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = shared_folder(spark)
    low = (1 << 33) - 1
    part, at, n, last, first, before = names = fresh(df, "_part", "_at", "_n", "_last", "_first", "_before")
    tagged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias(at))
    tagged.write.parquet(path)
    stored = spark.read.schema(tagged.schema).parquet(path)
    sizes = stored.groupBy(part).agg(F.count(F.lit(1)).alias(n), F.max_by(F.struct(*df.columns), at).alias(last))
    # One row for each partition.
    over = Window.orderBy(part)
    starts = sizes.select(part, (F.sum(n).over(over) - F.col(n)).alias(first), F.lag(last).over(over).alias(before))
    return stored, starts, [names[0], names[1], names[4], names[5]]


def with_position(df: DataFrame, keys: Sequence[Key], name: str = "pos", start: int = 0) -> DataFrame:
    """Adds each row's position (start, start + 1, ...) in the order of the keys, which must be total."""
    stored, starts, (part, at, first, _) = _ranged(df, keys)
    return stored.join(F.broadcast(starts.select(part, first)), part).select(*df.columns, (F.col(first) + F.col(at) + start).cast("bigint").alias(name))


def with_previous(df: DataFrame, keys: Sequence[Key], columns: Sequence[str], prefix: str = "prev_", position: str = "pos") -> DataFrame:
    """Adds the position and the previous row's `columns` (null in the first row), also across partitions."""
    stored, starts, (part, at, first, before) = _ranged(df, keys)
    over = Window.partitionBy(part).orderBy(at)
    own = stored.select("*", *[F.lag(c).over(over).alias(prefix + c) for c in columns])
    joined = own.join(F.broadcast(starts), part)
    edge = F.col(at) == 0
    return joined.select(*df.columns, (F.col(first) + F.col(at)).cast("bigint").alias(position), *[F.when(edge, F.col(f"{before}.{c}")).otherwise(F.col(prefix + c)).alias(prefix + c) for c in columns])


def dedupe_sorted(df: DataFrame, keys: Sequence[Key], tie_break: Sequence[Key] = ()) -> DataFrame:
    """The first row, by tie_break, of the rows that are equal in the keys; without tie_break, by their
    values (as JSON).

    One aggregation that combines before the shuffle, so a hot key is no hot task; only a tie_break
    of both directions takes a window."""
    if not keys:
        raise ValueError("duplicates are rows that are equal in the sorting columns; none are given")
    names = df.columns
    down = {k.descending for k in tie_break}
    if len(down) == 2:
        rank = fresh(df, "_rn")[0]
        over = Window.partitionBy(*[_value(df, k) for k in keys]).orderBy(*expressions(df, tie_break))
        return df.withColumn(rank, F.row_number().over(over)).where(F.col(rank) == 1).drop(rank)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    if not tie_break:
        first = F.min_by(row, F.to_json(row))
    else:
        # Nulls are last where the flag is: with the lowest first, a null's is 1; with the highest, 0.
        flag = lambda k: _value(df, k).isNull() if k.nulls_first == k.descending else _value(df, k).isNotNull()
        order = F.struct(*[x for k in tie_break for x in (flag(k), _value(df, k))])
        first = (F.max_by if down == {True} else F.min_by)(row, order)
    best = df.groupBy(*[_value(df, k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first.alias("_row"))
    return best.select("_row.*")


def limit(df: DataFrame, n: int, keys: Sequence[Key] = (), offset: int = 0) -> DataFrame:
    """n rows from `offset` on, in the order of the keys."""
    out = sort(df, keys) if keys else df
    return (out.offset(offset) if offset else out).limit(n)


def top_k(df: DataFrame, k: int, keys: Sequence[Key]) -> DataFrame:
    """The first k rows in order; each task keeps k."""
    return limit(df, k, keys)

"""Column statistics, logical pages, boundary order and search.

Physical pages can't be seen from Spark; a page is a run of `rows_per_page` rows in a given order.
A page without values has null bounds and takes no part in orders and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.sort import Key, shared_folder, with_position, with_previous

PROBES = 10_000  # probes that are broadcast at most
BITS, TOP = 4, 3  # the children of a node of positions, as a power of two; the levels that are broadcast


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts and bounds, the bounds as text."""
    aggs = []
    for c in columns:
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("null_count"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value")).alias(f"s_{c}"))
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"s_{c}") for c in columns])))


def bounds(df: DataFrame, column: str) -> DataFrame:
    """min_value and max_value in one pass; null when there is no value."""
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n_distinct"))


def value_count(df: DataFrame, column: str) -> DataFrame:
    """Values of a repeated column: an empty or null list counts once."""
    return df.agg(F.sum(F.greatest(F.coalesce(F.size(F.col(column)), F.lit(1)), F.lit(1)).cast("bigint")).alias("n_values"))


def page_index(df: DataFrame, column: str, keys: Sequence[Key], rows_per_page: int) -> DataFrame:
    """One row per page: page, first_row, n_rows, null_count, null_page, min_value, max_value."""
    placed = with_position(df.select(column, *[k.path for k in keys if k.path != column]), keys, "_pos")
    page = F.floor(F.col("_pos") / rows_per_page).cast("bigint")
    nulls = F.count_if(F.col(column).isNull())
    return placed.groupBy(page.alias("page")).agg(F.min("_pos").alias("first_row"), F.count(F.lit(1)).alias("n_rows"), nulls.alias("null_count"), (nulls == F.count(F.lit(1))).alias("null_page"), F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def roll_up(index: DataFrame) -> DataFrame:
    """The column chunk's statistics from its pages'."""
    return index.agg(F.sum("n_rows").alias("n_rows"), F.sum("null_count").alias("null_count"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def order_of(df: DataFrame, value: Column | str, keys: Sequence[Key]) -> DataFrame:
    """Whether a sequence is ascending or descending: is_ascending, is_descending."""
    named = df.select(*[k.path for k in keys], (F.col(value) if isinstance(value, str) else value).alias("_v")).where("_v IS NOT NULL")
    p = with_previous(named, keys, ["_v"], "prev_")
    up, down = F.col("prev__v") <= F.col("_v"), F.col("prev__v") >= F.col("_v")
    return p.agg(F.coalesce(F.bool_and(up), F.lit(True)).alias("is_ascending"), F.coalesce(F.bool_and(down), F.lit(True)).alias("is_descending"))


def boundary_order(index: DataFrame) -> DataFrame:
    """ASCENDING or DESCENDING if both the lower and the upper bounds of the pages are, else UNORDERED."""
    p = with_previous(index.where(~F.col("null_page")).select("page", "min_value", "max_value"), [Key("page")], ["min_value", "max_value"])
    up = (F.col("prev_min_value") <= F.col("min_value")) & (F.col("prev_max_value") <= F.col("max_value"))
    down = (F.col("prev_min_value") >= F.col("min_value")) & (F.col("prev_max_value") >= F.col("max_value"))
    both = p.agg(F.coalesce(F.bool_and(up), F.lit(True)).alias("up"), F.coalesce(F.bool_and(down), F.lit(True)).alias("down"))
    return both.select(F.when(F.col("up"), "ASCENDING").when(F.col("down"), "DESCENDING").otherwise("UNORDERED").alias("boundary_order"))


def _stored(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cover(lo: Column, hi: Column, levels: int) -> Column:
    """The nodes (level, node) that hold the positions from lo to hi and no others. A node of a level
    holds 2 ** (BITS * level) positions; what whole nodes of the level above hold is left to that level."""
    none = F.array().cast("array<bigint>")
    begin = lambda level: F.shiftright(lo + ((1 << BITS * level) - 1), BITS * level)
    end = lambda level: F.shiftright(hi + 1, BITS * level)

    def nodes(level: int) -> list[Column]:
        a, b = begin(level), end(level)
        left, right = F.shiftleft(begin(level + 1), BITS), F.shiftleft(end(level + 1), BITS)
        runs = ((a, F.least(left, b)), (F.greatest(left, right), b))
        some = [F.when(start < stop, F.sequence(start, stop - 1)).otherwise(none) for start, stop in runs]
        return [F.transform(x, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))) for x in some]

    return F.flatten(F.array(*[x for level in range(levels) for x in nodes(level)]))


def _first_holding(pages: DataFrame, values: DataFrame) -> DataFrame:
    """(_value, _page): the first page that holds each value, where one does. pages: (_id, page, min_value,
    max_value); values: distinct, not null.

    Bounds and values are numbered in one order (at equal values lower bounds come first, upper ones
    last), so a page holds the values of a run of positions. The run is cut into nodes of a tree of
    positions, a node keeps its first page, and a value meets the nodes above it by equality. The few
    nodes near the root, which many values share, are broadcast (under 2 * 2 ** (BITS * TOP) rows);
    a node below them holds at most a share of 2 ** -(BITS * (TOP - 1)) of all positions."""
    pages = pages.where("min_value <= max_value")
    edge = lambda c, kind: pages.select(F.col(c).alias("_value"), F.lit(kind).alias("_kind"), "_id", "page")
    points = values.select("_value", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_id"), F.lit(None).cast("bigint").alias("page"))
    ends = edge("min_value", 0).unionByName(points).unionByName(edge("max_value", 2))
    placed = _stored(with_position(ends, [Key("_value"), Key("_kind"), Key("_id")], "_pos"))
    levels = max(TOP, -(-placed.count().bit_length() // BITS) + 1)
    low = levels - TOP
    runs = placed.where("_kind <> 1").groupBy("_id").agg(F.first("page").alias("page"), F.min("_pos").alias("lo"), F.max("_pos").alias("hi"))
    nodes = runs.select("page", F.explode(_cover(F.col("lo"), F.col("hi"), levels)).alias("n")).groupBy("n.level", "n.node").agg(F.min("page").alias("_page"))
    nodes = _stored(nodes)
    above = lambda c, first, last: F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(c, BITS * (k - first)).alias("node")) for k in range(first, last)]))
    tops = nodes.sparkSession.range(1 << (BITS * TOP)).select(F.col("id").alias("top"), above(F.col("id"), low, levels).alias("n")).select("top", "n.*")
    tops = tops.join(F.broadcast(nodes.where(F.col("level") >= low)), ["level", "node"]).groupBy("top").agg(F.min("_page").alias("_page"))
    points = placed.where("_kind = 1").select("_value", "_pos")
    found = points.withColumn("top", F.shiftright("_pos", BITS * low)).join(F.broadcast(tops), "top").select("_value", "_page")
    if low:
        below = points.select("_value", above(F.col("_pos"), 0, low).alias("n")).select("_value", "n.*")
        found = found.unionByName(below.join(nodes.where(F.col("level") < low), ["level", "node"]).select("_value", "_page"))
    return found.groupBy("_value").agg(F.min("_page").alias("_page"))


def search(index: DataFrame, probes: DataFrame, value: str = "value") -> DataFrame:
    """For each probe, the first page whose bounds hold it; the number of pages if none does, or if it is null.

    Up to PROBES probes are broadcast to the pages; more meet them by way of a tree of positions,
    whose work grows with pages plus probes (times the tree's height). Pages and probes are written
    to the shared folder once."""
    index = _stored(index.select("page", "min_value", "max_value", "null_page", F.monotonically_increasing_id().alias("_id")))
    probes = _stored(probes)
    n_pages = index.agg(F.count(F.lit(1)).alias("_pages"))
    pages = index.where(~F.col("null_page")).drop("null_page")
    values = probes.select(F.col(value).alias("_value")).where("_value IS NOT NULL")
    if probes.count() <= PROBES:
        hit = pages.join(F.broadcast(values), F.col("_value").between(F.col("min_value"), F.col("max_value")))
        found = hit.groupBy("_value").agg(F.min("page").alias("_page"))
    else:
        found = _first_holding(pages, values.distinct())
    joined = probes.join(found, F.col(value) == F.col("_value"), "left")
    return joined.crossJoin(F.broadcast(n_pages)).select(value, F.coalesce("_page", "_pages").cast("bigint").alias("page"))


def _next_character(c: Column) -> Column:
    """The character after c in the order of code points, which is that of UTF-8 bytes."""
    point = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")
    after = F.when(point == 0xD7FF, 0xE000).otherwise(point + 1)  # no character between
    return F.decode(F.unhex(F.lpad(F.hex(after), 8, "0")), "UTF-32")


def truncated_bounds(df: DataFrame, column: str, size: int) -> DataFrame:
    """Bounds of a text column cut to `size` characters. The upper one, where it is cut, ends in a raised
    character, so that it still is a bound: the last one that can be raised, or null if none can."""
    b = bounds(df, column)
    kept = F.rtrim(F.substring("max_value", 1, size), F.lit(chr(0x10FFFF)))
    raised = F.when(F.length(kept) > 0, F.concat(F.substr(kept, F.lit(1), F.length(kept) - 1), _next_character(F.right(kept, F.lit(1)))))
    upper = F.when(F.length("max_value") > size, raised).otherwise(F.col("max_value"))
    return b.select(F.substring("min_value", 1, size).alias("min_value"), upper.alias("max_value"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

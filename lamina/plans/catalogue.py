"""The query catalogue: each operator applied to the driver's tables, with its SQL twin (DuckDB).

Results are compared without regard to order, so order is always a column (pos)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import casts, values
from lamina.operators import convert, dictionary, display, membership, merge, rows, sort, stats
from lamina.operators.sort import Key, ascending, descending, nulls_first
from lamina.sources import parquet, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return parquet.read(spark, f"{sf_dir}/{name}.parquet", columns=columns or None)


LINE = [Key("l_orderkey"), Key("l_linenumber"), Key("l_partkey"), Key("l_suppkey"), Key("l_quantity"), Key("l_extendedprice"), Key("l_shipdate")]
LINE_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


# --- scans and sources


@query("SELECT * FROM nation")
def scan_all(spark, sf_dir):
    return t(spark, sf_dir, "nation")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def project_subset(spark, sf_dir):
    return t(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(NULL AS VARCHAR) AS o_note FROM orders")
def scan_with_schema(spark, sf_dir):
    return parquet.read(spark, f"{sf_dir}/orders.parquet", "o_orderkey bigint, o_custkey bigint, o_note string")


@query("SELECT count(*) AS n_rows FROM lineitem")
def count_rows(spark, sf_dir):
    return parquet.row_count(t(spark, sf_dir, "lineitem"))


@query("SELECT r_regionkey, r_name FROM region WHERE false")
def empty_relation(spark, sf_dir):
    return parquet.empty(spark, t(spark, sf_dir, "region").schema)


@query("SELECT vec_id, unnest(embedding) AS value FROM embeddings")
def column_scan(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.explode_outer("embedding").alias("value"))


@query("SELECT unnest(embedding) AS value FROM embeddings")
def leaf_scan(spark, sf_dir):
    return parquet.column(t(spark, sf_dir, "embeddings"), "embedding")


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def concat_files(spark, sf_dir):
    return parquet.concat(spark, [f"{sf_dir}/orders.parquet"] * 2).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos >= 1000")
def seek_offset(spark, sf_dir):
    return rows.seek(t(spark, sf_dir, "orders", "o_orderkey"), 1000, [ascending("o_orderkey")])


@query("SELECT count(*) - 100 AS n_rows FROM orders")
def seek_in_file(spark, sf_dir):
    return parquet.row_count(parquet.seek_in_file(t(spark, sf_dir, "orders"), 100))


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos >= 500 AND pos < 700")
def page_slice(spark, sf_dir):
    return rows.page_slice(t(spark, sf_dir, "orders", "o_orderkey"), 500, 700, [ascending("o_orderkey")])


@query("SELECT 'p_partkey' AS \"column\", count(*) AS n_values, CAST(min(p_partkey) AS VARCHAR) AS \"min\", CAST(max(p_partkey) AS VARCHAR) AS \"max\" FROM part")
def footer_metadata(spark, sf_dir):
    f = parquet.footers(spark, f"{sf_dir}/part.parquet").where("column = 'p_partkey'")
    return f.groupBy("column").agg(F.sum("n_values").alias("n_values"), F.min(F.col("min").cast("bigint")).cast("string").alias("min"), F.max(F.col("max").cast("bigint")).cast("string").alias("max"))


@query("SELECT count(*) AS n_rows FROM customer")
def row_group_rows(spark, sf_dir):
    return parquet.files(t(spark, sf_dir, "customer")).agg(F.sum("n_rows").alias("n_rows"))


# --- filters and transforms


@query("SELECT * FROM lineitem WHERE l_quantity > 40")
def filter_rows(spark, sf_dir):
    return rows.filter_rows(t(spark, sf_dir, "lineitem"), F.col("l_quantity") > 40)


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0")
def filter_function(spark, sf_dir):
    return rows.filter_rows(t(spark, sf_dir, "part", "p_partkey", "p_size"), lambda f: f["p_size"] % 2 == 0)


def _written(spark: SparkSession, df: DataFrame, **options) -> DataFrame:
    path = sort.shared_folder(spark)
    sinks.write(df, path, **options)
    return parquet.read(spark, path, df.schema)


@query("SELECT * FROM orders WHERE o_totalprice > 200000")
def filter_write_roundtrip(spark, sf_dir):
    return _written(spark, rows.filter_rows(t(spark, sf_dir, "orders"), F.col("o_totalprice") > 200000), codec="zstd")


@query("SELECT event_id, ts, event_type FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE NOT (value < 95))")
def scan_while(spark, sf_dir):
    return rows.scan_while(t(spark, sf_dir, "events", "event_id", "ts", "event_type", "value"), F.col("value") < 95, [ascending("event_id")]).drop("value")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def scan_while_index(spark, sf_dir):
    return rows.scan_while_index(t(spark, sf_dir, "events", "event_id", "ts"), 25, [descending("ts"), ascending("event_id")]).select("event_id")


@query("SELECT l_orderkey, l_quantity * 2 AS double_quantity, upper(l_linestatus) || l_returnflag AS flags FROM lineitem")
def transform_rows(spark, sf_dir):
    return rows.transform(t(spark, sf_dir, "lineitem"), {"l_orderkey": F.col("l_orderkey"), "double_quantity": F.col("l_quantity") * 2, "flags": F.concat(F.upper("l_linestatus"), F.col("l_returnflag"))})


@query("SELECT event_id, value + 1 AS next_value FROM events WHERE event_type <> 'view'")
def transform_skip(spark, sf_dir):
    return rows.transform(t(spark, sf_dir, "events"), {"event_id": F.col("event_id"), "next_value": F.col("value") + 1}, skip=F.col("event_type") == "view")


@query("SELECT p_partkey, p_size * 10 AS size10 FROM part")
def transform_function(spark, sf_dir):
    return rows.transform(t(spark, sf_dir, "part", "p_partkey", "p_size"), lambda f: f.assign(size10=f["p_size"] * 10)[["p_partkey", "size10"]], "p_partkey bigint, size10 int")


@query("SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') IS NULL AS p_is_null FROM orders")
def null_index(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("p"))
    return rows.null_index(df, ["p"]).select("o_orderkey", "p_is_null")


# --- de-duplication


@query("""SELECT event_id, event_type, pos FROM (SELECT event_id, event_type, row_number() OVER w - 1 AS pos, lag(event_type) OVER w AS p FROM events WINDOW w AS (ORDER BY event_id))
          WHERE pos = 0 OR event_type IS DISTINCT FROM p""")
def dedupe_consecutive(spark, sf_dir):
    return rows.dedupe_consecutive(t(spark, sf_dir, "events", "event_id", "event_type"), ["event_type"], [ascending("event_id")])


@query("SELECT o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderdate")
def dedupe_sorted(spark, sf_dir):
    return sort.dedupe_sorted(t(spark, sf_dir, "orders", "o_orderdate", "o_orderkey"), [ascending("o_orderdate")], [ascending("o_orderkey")])


@query("SELECT l_orderkey, l_linenumber, min(l_partkey * 1000000 + l_suppkey) AS first_key FROM lineitem GROUP BY ALL")
def external_sort_dedupe(spark, sf_dir):
    path = sort.shared_folder(spark)
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("first_key"))
    sinks.write_sorted(df, path, [ascending("l_orderkey"), ascending("l_linenumber")], drop_duplicates=True, tie_break=[ascending("first_key")])
    return parquet.read(spark, path, df.schema)


# --- sorts, limits


def _sorted(name: str, table: str, keys: list[Key], sql: str, columns: list[str], replace: dict | None = None) -> None:
    def run(spark, sf_dir):
        df = t(spark, sf_dir, table)
        df = df.withColumns({k: F.expr(v) for k, v in (replace or {}).items()})
        return sort.with_position(df.select(*dict.fromkeys([*columns, *[k.path for k in keys]])), keys, "pos", 1).select(*columns, "pos")

    run.__name__ = name
    query(sql)(run)


_sorted("sort_asc", "orders", [ascending("o_totalprice"), ascending("o_orderkey")], "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM orders", ["o_orderkey"])
_sorted("sort_desc", "orders", [descending("o_totalprice"), ascending("o_orderkey")], "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders", ["o_orderkey"])
_sorted("sort_multi", "lineitem", [ascending("l_returnflag"), descending("l_shipdate"), *LINE], f"SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_shipdate DESC, {LINE_SQL}) AS pos FROM lineitem", ["l_orderkey", "l_linenumber"])
_NULLED = {"p": "nullif(o_orderpriority, '3-MEDIUM')"}
for _name, _key, _order in (("sort_nulls_last", ascending("p"), "ASC NULLS LAST"), ("sort_desc_nulls_last", descending("p"), "DESC NULLS LAST"), ("sort_nulls_first", nulls_first(ascending("p")), "ASC NULLS FIRST"), ("sort_desc_nulls_first", nulls_first(descending("p")), "DESC NULLS FIRST")):
    _sorted(_name, "orders", [_key, ascending("o_orderkey")], f"SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderpriority, '3-MEDIUM') {_order}, o_orderkey) AS pos FROM orders", ["o_orderkey"], _NULLED)
_sorted("sort_repeated", "embeddings", [ascending("embedding"), ascending("vec_id")], "SELECT vec_id, row_number() OVER (ORDER BY embedding, vec_id) AS pos FROM embeddings", ["vec_id"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(spark, sf_dir):
    return sort.top_k(t(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), 50, [descending("o_totalprice"), ascending("o_orderkey")])


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 20")
def limit_offset(spark, sf_dir):
    return sort.limit(t(spark, sf_dir, "customer", "c_custkey"), 30, [ascending("c_custkey")], 20)


@query("SELECT * FROM supplier")
def sorted_write(spark, sf_dir):
    path = sort.shared_folder(spark)
    df = t(spark, sf_dir, "supplier")
    sinks.write_sorted(df, path, [descending("s_acctbal"), ascending("s_suppkey")])
    return parquet.read(spark, path, df.schema)


# --- merges and set operations


@query("SELECT * FROM customer")
def merge_concat(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    low = F.coalesce(F.col("c_nationkey") < 12, F.lit(False))
    return merge.concat([c.where(low), c.where(~low)])


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def merge_sorted(spark, sf_dir):
    o = t(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    known = F.coalesce(F.col("o_orderstatus").isin("F", "O", "P"), F.lit(False))
    parts = [o.where(c).drop("o_orderstatus") for c in (*[F.col("o_orderstatus") == s for s in ("F", "O", "P")], ~known)]
    return merge.merge_positions(parts, [ascending("o_orderdate"), ascending("o_orderkey")])


@query("SELECT c_custkey AS k, c_name AS name, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def merge_converted(spark, sf_dir):
    target = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("bal", T.DoubleType())])
    return merge.concat([t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))], target)


# --- conversion and casts


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, k, o) for n, k, o in fields])


@query("SELECT c_custkey, '' AS required_text, CAST(0 AS BIGINT) AS required_long, CAST(NULL AS DOUBLE) AS optional_double, CAST([] AS BIGINT[]) AS repeated_long FROM customer")
def convert_missing(spark, sf_dir):
    return convert.convert(t(spark, sf_dir, "customer"), _schema(("c_custkey", T.LongType(), True), ("required_text", T.StringType(), False), ("required_long", T.LongType(), False), ("optional_double", T.DoubleType(), True), ("repeated_long", T.ArrayType(T.LongType()), False)))


@query("SELECT n_name, n_nationkey FROM nation")
def convert_extra(spark, sf_dir):
    return convert.convert(t(spark, sf_dir, "nation"), _schema(("n_name", T.StringType(), True), ("n_nationkey", T.IntegerType(), True)))


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), '') AS p FROM orders")
def convert_optional_to_required(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p"))
    return convert.convert(df, _schema(("o_orderkey", T.LongType(), True), ("p", T.StringType(), False)))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN CAST([] AS VARCHAR[]) ELSE [o_orderpriority] END AS p FROM orders")
def convert_to_repeated(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p"))
    return convert.convert(df, _schema(("o_orderkey", T.LongType(), True), ("p", T.ArrayType(T.StringType()), False)))


@query("SELECT vec_id, embedding[1] AS embedding FROM embeddings")
def convert_from_repeated(spark, sf_dir):
    return convert.convert(t(spark, sf_dir, "embeddings"), _schema(("vec_id", T.LongType(), True), ("embedding", T.FloatType(), False)))


def _cast(name: str, table: str, key: str, column: str, kind: T.DataType, sql: str, source: str | None = None) -> None:
    def run(spark, sf_dir):
        df = t(spark, sf_dir, table)
        c = F.expr(source or column)
        return df.select(key, casts.cast(c, df.select(c).schema[0].dataType, kind).alias("v"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS v FROM {table}")(run)


_cast("cast_bool_from_int", "part", "p_partkey", "p_size", T.BooleanType(), "p_size % 3 <> 0", "p_size % 3")
_cast("cast_bool_from_string", "orders", "o_orderkey", "o_orderstatus", T.BooleanType(), "o_orderstatus = 'F'", "if(o_orderstatus = 'F', 'T', 'false')")
_cast("cast_int_wraps", "orders", "o_orderkey", "o_orderkey", T.IntegerType(), "CAST(((o_orderkey * 1000003 + 2147483648) % 4294967296) - 2147483648 AS INTEGER)", "o_orderkey * 1000003")
_cast("cast_int_from_double", "orders", "o_orderkey", "o_totalprice", T.IntegerType(), "CAST(trunc(o_totalprice) AS INTEGER)")
_cast("cast_long_from_negative_double", "customer", "c_custkey", "c_acctbal", T.LongType(), "CAST(trunc(c_acctbal) AS BIGINT)")
_cast("cast_long_from_string", "orders", "o_orderkey", "o_orderpriority", T.LongType(), "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)", "substring(o_orderpriority, 1, 1)")
_cast("cast_float_from_double", "orders", "o_orderkey", "o_totalprice", T.FloatType(), "CAST(o_totalprice AS FLOAT)")
_cast("cast_double_from_int", "part", "p_partkey", "p_size", T.DoubleType(), "CAST(p_size AS DOUBLE)")
_cast("cast_string_from_long", "orders", "o_orderkey", "o_custkey", T.StringType(), "CAST(o_custkey AS VARCHAR)")
_cast("cast_string_from_double", "orders", "o_orderkey", "o_totalprice", T.StringType(), "regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')")
_cast("cast_string_from_date", "orders", "o_orderkey", "o_orderdate", T.StringType(), "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "to_date(o_orderdate)")
_cast("cast_date_from_timestamp", "orders", "o_orderkey", "o_orderdate", T.DateType(), "CAST(o_orderdate AS DATE)")
_cast("cast_date_from_string", "orders", "o_orderkey", "o_orderdate", T.DateType(), "CAST(o_orderdate AS DATE)", "date_format(o_orderdate, 'yyyy-MM-dd')")
_cast("cast_timestamp_from_date", "orders", "o_orderkey", "o_orderdate", T.TimestampNTZType(), "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)", "to_date(o_orderdate)")
_cast("cast_long_from_timestamp", "events", "event_id", "ts", T.LongType(), "epoch_us(ts)")


@query("SELECT event_id, epoch_us(ts) % 86400000000 AS v, epoch_us(ts) // 1000 AS millis FROM events")
def cast_time(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", casts.time_of_day(F.col("ts")).alias("v"), casts.rescale(F.unix_micros(F.col("ts").cast("timestamp")), 1_000_000, 1000).alias("millis"))


@query("SELECT n_nationkey, lower(regexp_replace(printf('%08X', n_nationkey), '(..)(..)(..)(..)', '\\4\\3\\2\\1')) AS v FROM nation")
def cast_binary_hex(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.lower(F.hex(casts.cast(F.col("n_nationkey"), T.IntegerType(), T.BinaryType()))).alias("v"))


@query("SELECT n_nationkey, n_nationkey + 70000 AS v FROM nation")
def cast_int_from_binary(spark, sf_dir):
    n = t(spark, sf_dir, "nation").withColumn("b", casts.cast((F.col("n_nationkey") + 70000).cast("int"), T.IntegerType(), T.BinaryType()))
    return n.select("n_nationkey", casts.cast(F.col("b"), T.BinaryType(), T.IntegerType()).alias("v"))


# --- statistics, pages, search

_STATS = {"orders": ["o_orderkey", "o_orderstatus", "o_custkey"], "part": ["p_partkey", "p_brand", "p_size"]}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM {k}" for k, v in _STATS.items() for c in v))
def column_stats(spark, sf_dir):
    return merge.concat([stats.column_stats(t(spark, sf_dir, k, *v), v) for k, v in _STATS.items()])


@query("SELECT min(l_shipdate) AS min_value, max(l_shipdate) AS max_value FROM lineitem")
def column_bounds(spark, sf_dir):
    return stats.bounds(t(spark, sf_dir, "lineitem", "l_shipdate"), "l_shipdate")


@query("SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def distinct_values(spark, sf_dir):
    return stats.distinct_count(t(spark, sf_dir, "lineitem", "l_partkey"), "l_partkey")


@query("SELECT CAST(sum(greatest(len(embedding), 1)) AS BIGINT) AS n_values FROM embeddings")
def value_count(spark, sf_dir):
    return stats.value_count(t(spark, sf_dir, "embeddings"), "embedding")


_PAGES_SQL = f"""SELECT pos // 256 AS page, min(pos) AS first_row, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS null_count, count(v) = 0 AS null_page, min(v) AS min_value, max(v) AS max_value
FROM (SELECT nullif(l_quantity, 50) AS v, row_number() OVER (ORDER BY {LINE_SQL}) - 1 AS pos FROM lineitem) GROUP BY 1"""


def _line_pages(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").withColumn("v", F.nullif(F.col("l_quantity"), F.lit(50.0)))
    return stats.page_index(df.select("v", *[k.path for k in LINE]), "v", LINE, 256)


@query(_PAGES_SQL)
def page_index(spark, sf_dir):
    return _line_pages(spark, sf_dir)


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_quantity = 50) AS null_count, min(nullif(l_quantity, 50)) AS min_value, max(nullif(l_quantity, 50)) AS max_value FROM lineitem")
def page_roll_up(spark, sf_dir):
    return stats.roll_up(_line_pages(spark, sf_dir))


def _order_pages(spark, sf_dir):
    return stats.page_index(t(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", [ascending("o_orderkey")], 256)


def _boundary_sql(pages: str) -> str:
    return f"""SELECT CASE WHEN bool_and(coalesce(pl <= lo AND ph <= hi, true)) THEN 'ASCENDING' WHEN bool_and(coalesce(pl >= lo AND ph >= hi, true)) THEN 'DESCENDING' ELSE 'UNORDERED' END AS boundary_order
FROM (SELECT lo, hi, lag(lo) OVER (ORDER BY page) AS pl, lag(hi) OVER (ORDER BY page) AS ph FROM (SELECT pos // 256 AS page, min(v) AS lo, max(v) AS hi FROM ({pages}) GROUP BY 1))"""


_KEY_PAGES, _PRICE_PAGES, _BACK_PAGES = (f"SELECT {c} AS v, row_number() OVER (ORDER BY {o}) - 1 AS pos FROM orders" for c, o in (("o_orderkey", "o_orderkey"), ("o_totalprice", "o_orderkey"), ("o_orderkey", "o_orderkey DESC")))


@query(" UNION ALL ".join(map(_boundary_sql, (_KEY_PAGES, _PRICE_PAGES, _BACK_PAGES))))
def boundary_order(spark, sf_dir):
    o = t(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    back = stats.page_index(o, "o_orderkey", [descending("o_orderkey")], 256)
    price = stats.page_index(o, "o_totalprice", [ascending("o_orderkey")], 256)
    return merge.concat([stats.boundary_order(p) for p in (_order_pages(spark, sf_dir), price, back)])


@query("""SELECT bool_and(coalesce(p <= o_totalprice, true)) AS is_ascending, bool_and(coalesce(p >= o_totalprice, true)) AS is_descending
          FROM (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS p FROM orders)""")
def order_of_column(spark, sf_dir):
    return stats.order_of(t(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", [ascending("o_orderkey")])


@query("""WITH p AS (SELECT pos // 256 AS page, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) GROUP BY 1),
          q AS (SELECT DISTINCT l_orderkey + 500000 * (l_orderkey % 2) AS value FROM lineitem)
          SELECT value, coalesce((SELECT min(page) FROM p WHERE value BETWEEN lo AND hi), (SELECT count(*) FROM p)) AS page FROM q""")
def page_search_all(spark, sf_dir):
    probes = t(spark, sf_dir, "lineitem", "l_orderkey").select((F.col("l_orderkey") + 500000 * (F.col("l_orderkey") % 2)).alias("value")).distinct()
    return stats.search(_order_pages(spark, sf_dir), probes)


@query("SELECT substr(min(p_name), 1, 8) AS min_value, CASE WHEN length(max(p_name)) > 8 THEN substr(max(p_name), 1, 7) || chr(ascii(substr(max(p_name), 8, 1)) + 1) ELSE max(p_name) END AS max_value FROM part")
def truncate_bounds(spark, sf_dir):
    return stats.truncated_bounds(t(spark, sf_dir, "part", "p_name"), "p_name", 8)


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def bloom_membership(spark, sf_dir):
    small = t(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    maybe = membership.maybe_in(t(spark, sf_dir, "lineitem", "l_partkey").distinct(), "l_partkey", [membership.build(small, "l_partkey")])
    return membership.member_of(maybe, small, "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')")
def membership_exact(spark, sf_dir):
    brand = t(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("l_partkey"))
    return membership.member_of(t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), brand, "l_partkey")


@query("SELECT p_partkey FROM part WHERE p_name IN (SELECT p_name FROM part)")
def bloom_write_roundtrip_all(spark, sf_dir):
    p = _written(spark, t(spark, sf_dir, "part"), bloom={"p_name": 20000}, plain=["p_name"])
    return membership.member_of(p, t(spark, sf_dir, "part", "p_name"), "p_name").select("p_partkey")


# --- dictionaries

_DICT_SQL = "SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1"


def _dictionary(spark, sf_dir):
    return dictionary.dictionary(t(spark, sf_dir, "events", "event_id", "event_type"), "event_type", [ascending("event_id")])


@query(_DICT_SQL)
def dictionary_page(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query(f"SELECT event_id, code FROM events JOIN ({_DICT_SQL}) d ON event_type = d.value")
def dictionary_encode(spark, sf_dir):
    return dictionary.encode(t(spark, sf_dir, "events", "event_id", "event_type"), "event_type", _dictionary(spark, sf_dir)).select("event_id", "code")


@query("SELECT event_id, event_type AS value FROM events")
def dictionary_decode(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    return dictionary.decode(dictionary.encode(t(spark, sf_dir, "events", "event_id", "event_type"), "event_type", d), d).select("event_id", "value")


@query("SELECT min(event_type) AS min_value, max(event_type) AS max_value FROM events")
def dictionary_bounds_all(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    return dictionary.bounds(dictionary.encode(t(spark, sf_dir, "events", "event_id", "event_type"), "event_type", d), d)


# --- scalars, building, copying, display


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_assign(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey, nullif(o_custkey % 5, 0) AS v FROM orders")
def null_if_zero(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", values.null_if_zero(F.col("o_custkey") % 5, T.LongType()).alias("v"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '2-HIGH'), '<null>') AS v FROM orders")
def value_text(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", values.text(F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH"))).alias("v"))


@query("SELECT n_nationkey, length(n_name) - length(replace(n_name, 'A', '')) AS n FROM nation")
def byte_count(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", values.count_byte(F.col("n_name").cast("binary"), ord("A")).cast("bigint").alias("n"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at, turn, role, text FROM conversations")
def row_builder(spark, sf_dir):
    built = rows.build_rows(t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["turn", "role", "text"])
    return rows.flatten_rows(built, ["conv_id"])


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def tee_copy(spark, sf_dir):
    paths = [sort.shared_folder(spark) for _ in range(2)]
    sinks.tee(t(spark, sf_dir, "region"), paths)
    return parquet.concat(spark, paths)


@query("SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def copy_rows(spark, sf_dir):
    path = sort.shared_folder(spark)
    sinks.copy(t(spark, sf_dir, "nation"), path, _schema(("n_name", T.StringType(), True), ("n_nationkey", T.LongType(), True)))
    return parquet.read(spark, path)


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1")
def append_rows(spark, sf_dir):
    path = sort.shared_folder(spark)
    n = t(spark, sf_dir, "nation")
    sinks.write(n, path, max_rows_per_file=10)
    sinks.append(n.where("n_regionkey = 1"), path)
    return parquet.read(spark, path)


@query("SELECT r_regionkey, 'value' AS note FROM region")
def key_value_metadata(spark, sf_dir):
    r = _written_as_is(spark, sinks.with_metadata(t(spark, sf_dir, "region"), {"note": "value"}))
    return r.select("r_regionkey", F.lit(sinks.metadata_of(r, "note")).alias("note"))


def _written_as_is(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = sort.shared_folder(spark)
    sinks.write(df, path)
    return parquet.read(spark, path)


@query()
def display_schema(spark, sf_dir):
    return display.schema_lines(t(spark, sf_dir, "nation"), "nation")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, coalesce(nullif(r_name, 'ASIA'), '<null>') AS r_name FROM region")
def display_rows(spark, sf_dir):
    r = t(spark, sf_dir, "region")
    return display.rows(r.withColumn("r_name", F.nullif(F.col("r_name"), F.lit("ASIA"))))


@query("""SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos
          FROM (SELECT o_orderdate, min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 100000 GROUP BY 1)""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large orders, the first of each day, from the latest day on."""
    large = rows.filter_rows(t(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice"), F.col("o_totalprice") > 100000)
    first = sort.dedupe_sorted(large, [ascending("o_orderdate")], [ascending("o_orderkey")])
    return sort.with_position(first.select("o_orderkey", "o_orderdate"), [descending("o_orderdate"), ascending("o_orderkey")], "pos", 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

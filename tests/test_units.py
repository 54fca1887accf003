"""Units that the catalogue doesn't reach: edge cases of operators, schemas, casts and streams."""

import datetime
import math
import random

import numpy as np
import pytest
from compare import SF
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import casts, schema, values
from lamina.operators import convert, dictionary, display, membership, merge, rows, sort, stats
from lamina.operators.sort import Key, ascending, descending, nulls_first
from lamina.plans import catalogue
from lamina.sources import parquet, sinks


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl).repartition(3)


@pytest.mark.parametrize("pages,answers", [
    ([list(range(10)), [10] * 4, [21, 22, 24, 25, 30], [30, 30], [30, 31], [32], list(range(42, 50))], {10: 1, 0: 0, 9: 0, 23: 2, 30: 2, 31: 4, 99: 7, -1: 7}),
    ([[10] * 4, list(range(10)), [21, 22, 23, 24, 25], list(range(19, 10, -1)), list(range(42, 50))], {10: 0, 0: 1, 9: 1, 48: 4, 15: 3, 99: 5, -1: 5}),
])
def test_search_finds_the_first_page(spark, pages, answers):
    index = frame(spark, [(i, min(p), max(p), False) for i, p in enumerate(pages)] + [], "page long, min_value long, max_value long, null_page boolean")
    probes = frame(spark, [(v,) for v in answers], "value long")
    assert {r.value: r.page for r in stats.search(index, probes).collect()} == answers


def test_search_in_blocks_of_probes(spark, monkeypatch):
    monkeypatch.setattr(stats, "PROBES", 3)
    index = frame(spark, [(0, 0, 9, False), (1, 5, 20, False)], "page long, min_value long, max_value long, null_page boolean")
    probes = frame(spark, [(v,) for v in range(25)], "value long")
    assert {r.value: r.page for r in stats.search(index, probes).collect()} == {v: 0 if v < 10 else 1 if v < 21 else 2 for v in range(25)}


def test_search_and_membership_take_all_probes(spark, monkeypatch):
    monkeypatch.setattr(stats, "PROBES", 400)
    keys = sorted(r.o_orderkey for r in catalogue.t(spark, SF, "orders", "o_orderkey").collect())
    page = {k: i // 256 for i, k in enumerate(keys)}
    edges = [(keys[i], keys[min(i + 255, len(keys) - 1)]) for i in range(0, len(keys), 256)]
    probes = {r.l_orderkey + 500000 * (r.l_orderkey % 2) for r in catalogue.t(spark, SF, "lineitem", "l_orderkey").collect()}
    want = {v: page.get(v, next((i for i, (a, b) in enumerate(edges) if a <= v <= b), len(edges))) for v in probes}
    assert {r.value: r.page for r in catalogue.QUERIES["page_search_all"](spark, SF).collect()} == want
    parts = {r.p_partkey for r in catalogue.t(spark, SF, "part", "p_partkey").collect()}
    assert {r.p_partkey for r in catalogue.QUERIES["bloom_write_roundtrip_all"](spark, SF).collect()} == parts


def test_search_makes_its_pages_and_probes_once(spark, monkeypatch):
    monkeypatch.setattr(stats, "PROBES", 3)
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    index = spark.createDataFrame([(0, 0, 9, False), (1, 5, 20, False)], "page long, min_value long, max_value long, null_page boolean")
    probes = spark.createDataFrame([(v,) for v in range(25)], "value long").mapInPandas(counted, "value long")
    assert stats.search(index, probes).count() == 25
    assert made.value == 25


def test_positions_and_previous_rows_cross_partitions(spark):
    data = [(i * 7 % 1000, i) for i in range(1000)]
    out = sort.with_previous(frame(spark, data, "k long, v long"), [ascending("k")], ["v"]).orderBy("pos").collect()
    want = sorted(data)
    assert [(r.k, r.v, r.pos, r.prev_v) for r in out] == [(k, v, i, want[i - 1][1] if i else None) for i, (k, v) in enumerate(want)]
    assert sort.with_position(frame(spark, data, "k long, v long").limit(0), [ascending("k")]).count() == 0


@pytest.mark.parametrize("key,order", [(ascending("a"), ["test1", "test2", None]), (descending("a"), ["test2", "test1", None]), (nulls_first(ascending("a")), [None, "test1", "test2"]), (nulls_first(descending("a")), [None, "test2", "test1"])])
def test_null_placement(spark, key, order):
    df = frame(spark, [("test1",), (None,), ("test2",)], "a string")
    assert [r.a for r in sort.sort(df, [key]).collect()] == order


def test_repeated_keys_compare_elements_and_empty_counts_as_null(spark):
    df = frame(spark, [([],), ([2],), ([1, 5],), ([1],), (None,)], "a array<int>")
    out = [r.a for r in sort.sort(df, [ascending("a")]).collect()]
    assert out[:3] == [[1], [1, 5], [2]] and {str(x) for x in out[3:]} == {"[]", "None"}


def test_scan_while_stops_at_null_and_at_the_first_false(spark):
    df = frame(spark, [(i, i if i != 4 else None) for i in range(10)], "k long, v long")
    assert sorted(r.k for r in rows.scan_while(df, F.col("v") < 7, [ascending("k")]).collect()) == [0, 1, 2, 3]
    assert sorted(r.k for r in rows.scan_while(df, F.col("v") > 6, [descending("k")]).collect()) == [7, 8, 9]
    assert rows.scan_while(df, F.lit(True), [ascending("k")]).count() == 10


def test_consecutive_duplicates(spark):
    df = frame(spark, [(i, i // 3 if i % 9 else None) for i in range(100)], "k long, v long")
    want, last = [], object()
    for i in range(100):
        v = i // 3 if i % 9 else None
        if v != last:
            want.append(i)
        last = v
    assert sorted(r.k for r in rows.dedupe_consecutive(df, ["v"], [ascending("k")]).collect()) == want


def test_deduplication_needs_keys(spark):
    with pytest.raises(ValueError):
        sort.dedupe_sorted(spark.range(3), [])
    df = frame(spark, [(1, 5), (1, 3), (None, 2), (None, 1)], "k long, v long")
    assert {tuple(r) for r in sort.dedupe_sorted(df, [ascending("k")], [ascending("v")]).collect()} == {(1, 3), (None, 1)}
    assert {tuple(r) for r in sort.dedupe_sorted(df, [ascending("k")], [descending("v")]).collect()} == {(1, 5), (None, 2)}


def test_merges_take_rows_with_null_and_other_values(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    orders = spark.createDataFrame([(i, day, s) for i, s in enumerate(["F", "O", "P", "X", None])], "o_orderkey long, o_orderdate timestamp_ntz, o_orderstatus string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3), (2, 12), (3, None)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(tuple(r)[::2] for r in catalogue.QUERIES["merge_sorted"](spark, str(tmp_path)).select("o_orderkey", "o_orderdate", "pos").collect()) == [(i, i) for i in range(5)]
    assert sorted(r.c_custkey for r in catalogue.QUERIES["merge_concat"](spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_merge_checks_keys_and_schemas(spark):
    a, b = spark.range(3), spark.range(3).withColumnRenamed("id", "other")
    with pytest.raises(ValueError):
        merge.concat([a, b])
    with pytest.raises(ValueError):
        merge.merge([a], [ascending("id")], sorted_by=[[descending("id")]])
    out = merge.merge([a, a], [ascending("id")], ordinal="input").collect()
    assert [(r.id, r.input) for r in out] == [(i, j) for i in range(3) for j in range(2)]


CONTACT = "array<struct<name:string,phone:string>>"


def test_conversion_of_groups_and_lists(spark):
    df = frame(spark, [("Luke", [("Leia", "1")], ("x", 1)), (None, None, None)], f"owner string, contacts {CONTACT}, g struct<a:string,b:int>")
    to = T.StructType([
        T.StructField("owner", T.ArrayType(T.StringType()), False), T.StructField("contacts", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.LongType(), False), T.StructField("note", T.StringType())])), False),
        T.StructField("g", T.StructType([T.StructField("a", T.StringType(), False), T.StructField("b", T.LongType(), False)]), False),
    ])
    out = [r.asDict(recursive=True) for r in convert.convert(df, to).collect()]
    assert {"owner": ["Luke"], "contacts": [{"name": "Leia", "age": 0, "note": None}], "g": {"a": "x", "b": 1}} in out
    assert {"owner": [], "contacts": [], "g": {"a": "", "b": 0}} in out
    with pytest.raises(convert.ConvertError):
        convert.convert(df, T.StructType([T.StructField("g", T.LongType())]))
    assert convert.surviving_keys([Key("owner"), Key("gone"), Key("g")], to) == [Key("owner")]


CASTS = [
    (T.BooleanType(), True, T.IntegerType(), 1), (T.BooleanType(), False, T.StringType(), "false"), (T.BooleanType(), True, T.BinaryType(), b"\x01"),
    (T.IntegerType(), 10, T.BooleanType(), True), (T.IntegerType(), 10, T.BinaryType(), b"\n\0\0\0"), (T.IntegerType(), -1, T.BinaryType(), b"\xff" * 4), (T.IntegerType(), 42, T.StringType(), "42"),
    (T.LongType(), 4294967297, T.IntegerType(), 1), (T.LongType(), -2147483649, T.IntegerType(), 2147483647), (T.LongType(), 300, T.ByteType(), 44), (T.LongType(), 7, T.BinaryType(), b"\x07" + b"\0" * 7),
    (T.DoubleType(), -1.9, T.LongType(), -1), (T.DoubleType(), 1.9, T.IntegerType(), 1), (T.DoubleType(), 1.0, T.StringType(), "1"), (T.DoubleType(), 1e20, T.StringType(), "100000000000000000000"), (T.DoubleType(), 1e21, T.StringType(), "1e+21"), (T.DoubleType(), 1e-5, T.StringType(), "1e-05"),
    (T.FloatType(), 0.5, T.StringType(), "0.5"), (T.FloatType(), 1.5, T.BinaryType(), b"\0\0\xc0?"), (T.DoubleType(), 1.5, T.BinaryType(), b"\0\0\0\0\0\0\xf8?"), (T.BinaryType(), b"\0\0\xc0?", T.FloatType(), 1.5), (T.BinaryType(), b"\0\0\0\0\0\0\xf8?", T.DoubleType(), 1.5),
    (T.BinaryType(), b"\x01\x02", T.IntegerType(), 513), (T.BinaryType(), b"\xff\xff\xff\xff", T.IntegerType(), -1), (T.BinaryType(), b"\xff" * 9, T.LongType(), -1), (T.BinaryType(), b"\0\0", T.BooleanType(), False), (T.BinaryType(), b"\0\x10", T.BooleanType(), True),
    (T.StringType(), "t", T.BooleanType(), True), (T.StringType(), "-12", T.IntegerType(), -12), (T.StringType(), "True", T.BooleanType(), True), (T.StringType(), "abc", T.BinaryType(), b"abc"), (T.StringType(), "1969-12-31", T.DateType(), datetime.date(1969, 12, 31)),
    (T.DateType(), datetime.date(2020, 2, 29), T.StringType(), "2020-02-29"), (T.DateType(), datetime.date(1970, 1, 3), T.IntegerType(), 2), (T.IntegerType(), 2, T.DateType(), datetime.date(1970, 1, 3)),
    (T.TimestampNTZType(), datetime.datetime(1970, 1, 1, 0, 0, 1), T.LongType(), 1_000_000), (T.TimestampNTZType(), datetime.datetime(1969, 12, 31, 12), T.DateType(), datetime.date(1969, 12, 31)), (T.TimestampNTZType(), datetime.datetime(1970, 1, 1, 0, 0, 1), T.StringType(), "1000000"),
]


def test_casts(spark):
    for have, value, want, answer in CASTS:
        df = spark.createDataFrame([(value,), (None,)], T.StructType([T.StructField("v", have)]))
        got = [r[0] for r in df.select(casts.cast(F.col("v"), have, want).alias("v")).collect()]
        got = [bytes(x) if isinstance(x, bytearray) else x for x in got]
        assert got == [answer, None], (have, value, want)


@pytest.mark.parametrize("have,value,want", [(T.StringType(), "yes", T.BooleanType()), (T.StringType(), "1.5", T.IntegerType()), (T.StringType(), "99999999999", T.IntegerType()), (T.StringType(), "no date", T.DateType())])
def test_casts_that_fail(spark, have, value, want):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", have)]))
    with pytest.raises(PySparkException):
        df.select(casts.cast(F.col("v"), have, want)).collect()


def test_times_and_fixed_bytes(spark):
    df = spark.createDataFrame([(datetime.datetime(2020, 1, 1, 13, 5, 7, 250_000), "0a0b")], "t timestamp_ntz, s string")
    r = df.select(casts.time_of_day(F.col("t")).alias("a"), casts.time_text(casts.time_of_day(F.col("t"))).alias("b"), casts.to_fixed(F.col("s"), T.StringType(), 3).alias("c"), casts.rescale(F.lit(-1999), 1000, 1).alias("d")).head()
    assert (r.a, r.b, bytes(r.c), r.d) == (47107250000, "13:05:07.25", b"\x0a\x0b\0", -1)


def test_shortest_floats():
    assert [casts.shortest(x) for x in (0.1, 100.0, 1e-4, 123456789.125, float("inf"), float("nan"))] == ["0.1", "100", "0.0001", "123456789.125", "+Inf", "NaN"]


def test_parse_value():
    assert values.parse_value(b"\xff\xff\xff\xff", "int32") == -1 and values.parse_value(None, "int32") is None and math.isclose(values.parse_value(b"\0\0\xc0?", "float"), 1.5)
    with pytest.raises(ValueError):
        values.parse_value(b"\0", "int64")


def test_schema_language():
    s = schema.schema(a="int32 optional", b="string repeated", c="decimal(2:9) zstd", d="fixed(16)", e="map(string,int64)", f="uuid")
    assert s["a"].nullable and isinstance(s["b"].dataType, T.ArrayType) and s["c"].dataType == T.DecimalType(9, 2) and s["d"].metadata == {"length": 16}
    for bad in ("int32 optional optional", "nothing", "int32 quick"):
        with pytest.raises(ValueError):
            schema.column("x", bad)
    assert schema.schemas_equal(s, schema.schema(a="int32 optional", b="string repeated", c="decimal(2:9) gzip", d="fixed(16)", e="map(string,int64)", f="uuid"))
    assert not schema.schemas_equal(s, schema.schema(b="string repeated"))
    nested = T.StructType([T.StructField("x", T.ArrayType(T.StructType([T.StructField("y", T.LongType())])))])
    assert schema.lookup(nested, "x", "y").dataType == T.LongType() and schema.lookup(nested, "x") is None and schema.lookup(nested, "z") is None
    assert schema.leaves(nested) == [("x", "y")]
    assert [schema.decimal_bytes(p) for p in (1, 2, 3, 9, 18, 38)] == [1, 1, 2, 4, 8, 16]
    assert schema.message(nested, "m") == "message m {\n    optional group x (LIST) {\n        repeated group list {\n            optional group element {\n                optional int64 y (INT(64,true));\n            }\n        }\n    }\n}"


def test_bloom_filters_have_no_false_negatives(spark):
    some = frame(spark, [(f"v{i}",) for i in range(2000)], "v string")
    f = membership.build(some, "v", 10)
    assert membership.maybe_in(some, "v", [f]).count() == 2000
    others = frame(spark, [(f"w{i}",) for i in range(5000)], "v string")
    assert membership.maybe_in(others, "v", [f]).count() < 250
    assert membership.maybe_in(others, "v", [f, None]).count() == 5000
    assert membership.blocks_for(0, 10) == 1 and membership.blocks_for(1000, 10) == 40
    words = np.zeros((4, 8), np.uint32)
    membership.insert(words, np.array([1 << 63, 5], np.uint64))
    assert membership.check(words, np.array([1 << 63, 5], np.uint64)).all()


def test_xxh64_has_seed_zero(spark):
    assert spark.range(1).select(values.xxh64(F.lit(b"")).alias("h")).head().h == 0xEF46DB3751D8E999 - (1 << 64)


def test_dictionary_order_and_nulls(spark):
    df = frame(spark, [(0, "b"), (1, None), (2, "a"), (3, "b")], "k long, v string")
    d = dictionary.dictionary(df, "v", [ascending("k")])
    assert {(r.code, r.value) for r in d.collect()} == {(0, "b"), (1, "a")}
    assert sorted((r.k, r.code) for r in dictionary.encode(df, "v", d).collect()) == [(0, 0), (1, None), (2, 1), (3, 0)]
    assert dictionary.value_at(d, 1).head().value == "a"


def test_dictionary_bounds_take_all_events(spark):
    kinds = [r.event_type for r in catalogue.t(spark, SF, "events", "event_type").collect()]
    assert [tuple(r) for r in catalogue.QUERIES["dictionary_bounds_all"](spark, SF).collect()] == [(min(kinds), max(kinds))]


def test_sinks(spark, tmp_path):
    df = frame(spark, [(i, str(i)) for i in range(100)], "k long, v string")
    for codec in sinks.CODECS:
        sinks.write(df, str(tmp_path / codec), codec=codec, bloom={"v": 100}, sort_by=[descending("k")])
        assert parquet.read(spark, str(tmp_path / codec)).count() == 100
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "x"), codec="brotli")
    with pytest.raises(ValueError):
        sinks.append(df.select("k"), str(tmp_path / "zstd"))
    sinks.write(df, str(tmp_path / "split"), max_rows_per_file=30, single_file=True)
    assert len(list((tmp_path / "split").glob("*.parquet"))) == 4
    sinks.write_sorted(df, str(tmp_path / "sorted"), [descending("k")])
    out = [r.k for p in sorted((tmp_path / "sorted").glob("*.parquet")) for r in spark.read.parquet(str(p)).collect()]
    assert out == list(range(99, -1, -1))
    with pytest.raises(ValueError):
        sinks.write_sorted(df, str(tmp_path / "y"), [])
    assert [len(b) for b in parquet.rows(df, 40)] == [40, 40, 20]


def test_truncated_bounds_and_display(spark):
    df = frame(spark, [("alpha",), ("omega",)], "v string")
    assert tuple(stats.truncated_bounds(df, "v", 3).head()) == ("alp", "omf")
    assert tuple(stats.truncated_bounds(df, "v", 9).head()) == ("alpha", "omega")
    assert display.table(spark.createDataFrame([(1, None)], "a int, b string")) == "+---+--------+\n| a | b      |\n+---+--------+\n| 1 | <null> |\n+---+--------+"


def test_stream_deduplication(spark, tmp_path):
    from lamina.streaming.rows import dedupe_consecutive

    spark.createDataFrame([(i, "u", i // 3) for i in range(12)], "k long, user string, v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, user string, v long").parquet(str(tmp_path / "in"))
    q = dedupe_consecutive(stream, "user", ["v"], "k").writeStream.format("memory").queryName("deduped").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("deduped").collect()) == [0, 3, 6, 9]


@pytest.mark.parametrize("top", [1, 3])
def test_search_among_overlapping_pages(spark, monkeypatch, top):
    monkeypatch.setattr(stats, "PROBES", 3)
    monkeypatch.setattr(stats, "TOP", top)
    rng = random.Random(top)
    pages = []
    for page in range(300):
        a = rng.choice([rng.randrange(2000), 500])
        pages.append((page, a, a + rng.choice([0, 1, 7, 60, 900]), False))
    pages += [(300, None, None, True), (301, 90, 80, False), (302, 5000, 6000, False)]
    rng.shuffle(pages)
    values = [*range(-3, 3100), 500, 500, 5000, 5999, 6000, 6001, None]
    index = spark.createDataFrame(pages, "page long, min_value int, max_value int, null_page boolean").repartition(3)
    probes = spark.createDataFrame([(v,) for v in values], "value long").repartition(3)
    held = lambda v: min((p for p, a, b, null in pages if v is not None and not null and a <= v <= b), default=len(pages))
    got = sorted(((r.value, r.page) for r in stats.search(index, probes).collect()), key=str)
    assert got == sorted(((v, held(v)) for v in values), key=str)
    assert stats.search(index.limit(0), probes).where("page <> 0").isEmpty()

"""Operators on what queries over the tables don't reach: raised bounds, wide decimals, key orders, names, footers."""

from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.casts import cast, rescale
from lamina.functions.values import count_byte
from lamina.operators import dictionary, rows, stats
from lamina.operators.sort import Key, ascending, dedupe_sorted, descending, with_position, with_previous
from lamina.sources import parquet


@pytest.mark.parametrize("values,size", [(["zz\u00e9 tail", "a"], 3), (["ab\U0010ffff\U0010fffftail"], 4), (["x\ud7fftail"], 2), (["\U0010ffff\U0010ffffz"], 2), (["abc"], 3), (["ab\x7fz"], 3)])
def test_truncated_bounds_are_bounds(spark, values, size):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    r = stats.truncated_bounds(df, "v", size).head()
    top = max(values, key=lambda v: v.encode())
    assert len(r.min_value) <= size and r.min_value.encode() <= min(v.encode() for v in values)
    if set(top[:size]) == {"\U0010ffff"}:
        assert r.max_value is None
    else:
        assert len(r.max_value) <= size and r.max_value.encode() >= top.encode()


def test_rescale_is_exact(spark):
    df = spark.createDataFrame([(1700000000123456999,), (-1700000000123456999,), (None,)], "t long")
    assert [r[0] for r in df.select(rescale(F.col("t"), 10**9, 10**6)).collect()] == [1700000000123456, -1700000000123456, None]


@pytest.mark.parametrize("value", [0, 1, -1, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 2**64 + 5, 10**28 + 7, -(10**28) - 7])
def test_wide_decimals_wrap(spark, value):
    df = spark.createDataFrame([(Decimal(value),)], "d decimal(29,0)")
    r = df.select(*[cast(F.col("d"), T.DecimalType(29, 0), k).alias(n) for n, k in (("l", T.LongType()), ("i", T.IntegerType()))]).head()
    wrapped = lambda bits: (value + (1 << (bits - 1))) % (1 << bits) - (1 << (bits - 1))
    assert (r.l, r.i) == (wrapped(64), wrapped(32))


def test_dictionary_follows_its_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (None, "d")], "k int, v string")
    codes = lambda *keys: {r.value: r.code for r in dictionary.dictionary(df, "v", keys).collect()}
    assert codes(ascending("k")) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert codes(descending("k")) == {"c": 0, "a": 1, "b": 2, "d": 3}
    assert codes(Key("k", nulls_first=True)) == {"d": 0, "a": 1, "b": 2, "c": 3}


def test_probe_looks_up_and_inserts(spark):
    of = spark.createDataFrame([(0, "x"), (1, "y")], "code long, value string")
    values = spark.createDataFrame([(1, "y"), (2, "q"), (3, None), (4, "p"), (5, "q")], "k int, value string")
    coded, grown = dictionary.probe(of, values, [ascending("k")])
    assert sorted((r.k, r.code, r.is_new) for r in coded.collect()) == [(1, 1, False), (2, 2, True), (3, None, None), (4, 3, True), (5, 2, True)]
    assert {r.value: r.code for r in grown.collect()} == {"x": 0, "y": 1, "q": 2, "p": 3}


def test_columns_of_any_name(spark):
    names = ["_RN", "_at", "_Part", "_stop", "_pos", "_prev_k", "_first", "_before", "_value", "_code"]
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "k int, g int").withColumns({n: F.lit(7) for n in names}).repartition(3)
    whole = lambda out: all(r[n] == 7 for r in out.collect() for n in names)
    assert whole(with_position(df, [ascending("k")])) and whole(with_previous(df, [ascending("k")], ["k"], "before_"))
    for order in ([], [ascending("k")], [descending("k")], [ascending("g"), descending("k")]):
        out = dedupe_sorted(df, [ascending("g")], order)
        assert out.columns == df.columns and whole(out)
        assert sorted(r.k for r in out.collect()) == ([6, 7, 8] if order and order[-1].descending else [0, 1, 2])
    assert whole(rows.dedupe_consecutive(df, ["k"], [ascending("k")]))
    for key in (ascending("k"), descending("k")):
        out = rows.scan_while(df, F.col("k") != 4, [key])
        assert out.columns == df.columns and out.count() == 4
    of = dictionary.dictionary(df, "g", [ascending("k")])
    assert whole(dictionary.decode(dictionary.encode(df, "g", of), of))


@pytest.mark.parametrize("nulls_first", [False, True])
@pytest.mark.parametrize("down", [False, True])
def test_tie_breaks_place_nulls(spark, nulls_first, down):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 9)], "g int, k int")
    key = Key("k", descending=down, nulls_first=nulls_first)
    assert dedupe_sorted(df, [ascending("g")], [key]).head().k == (None if nulls_first else 9 if down else 5)


def test_footers_row_groups_and_pairs(spark, tmp_path):
    table = pa.table({"a": pa.array(range(100), pa.int64()), "b": [f"t{i}" for i in range(100)]}).replace_schema_metadata({"hello": "world", "n": "1"})
    path = str(tmp_path / "x.parquet")
    pq.write_table(table, path, row_group_size=30)
    assert {r.value for r in parquet.key_values(spark, path, "hello").collect()} == {"world"}
    assert parquet.key_values(spark, path, "none").count() == 0
    assert sorted({(r.row_group, r.n_rows) for r in parquet.footers(spark, path).collect()}) == [(0, 30), (1, 30), (2, 30), (3, 10)]
    assert sorted(r.a for r in parquet.row_group(spark, path, 2).collect()) == list(range(60, 90))
    with pytest.raises(IndexError):
        parquet.row_group(spark, path, 4)
    other = T.StructType([T.StructField("a", T.StringType()), T.StructField("c", T.IntegerType())])
    assert {tuple(r) for r in parquet.read_as(spark, path, other).collect()} == {(str(i), None) for i in range(100)}


def test_count_byte_and_json(spark):
    df = spark.createDataFrame([(bytearray(b"a\x00\xffa\xe9"),), (bytearray(b""),), (None,), (bytearray(b"a" * 200_000),)], "b binary")
    for value in (0, 97, 255, 233, 92):
        want = [None if r.b is None else bytes(r.b).count(value) for r in df.collect()]
        assert [r[0] for r in df.select(count_byte(F.col("b"), value)).collect()] == want
    assert rows.to_json(spark.createDataFrame([(1, None)], "a int, `b c` string")).head().json == '{"a":1,"b c":null}'

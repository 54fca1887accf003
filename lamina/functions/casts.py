"""The cast table between column types. Results don't depend on the session's ANSI setting.

  to boolean    a number is true unless zero; bytes if any isn't zero; text: 1 t T true TRUE True,
                0 f F false FALSE False, anything else is an error
  to int, long  integers wrap around, fractions are cut off toward zero; bytes are little-endian,
                padded with zeros; text is a decimal number or an error
  to decimal    as a number
  to float      as a number; bytes are its bits
  to binary     numbers become little-endian bytes, text its UTF-8
  to fixed(n)   bytes padded with zeros or cut to n; text is hexadecimal
  to string     true/false, digits, shortest float text (exponent below 1e-4 and from 1e21 on),
                ISO dates, hexadecimal of fixed bytes, microseconds of timestamps
  to date       from text YYYY-MM-DD; from timestamps, the day (before 1970 too)
  to timestamp  from dates, midnight; from integers, microseconds

Nulls stay null. Unsigned values keep their value, decimals their scale.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.values import little_endian

# The words for booleans.
TRUE, FALSE = ("1", "t", "T", "true", "TRUE", "True"), ("0", "f", "F", "false", "FALSE", "False")

_INTS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def _is(kind: T.DataType, *classes) -> bool:
    return isinstance(kind, classes)


def _failed(c: Column, what: str, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"not {what}: "), F.coalesce(c.cast("string"), F.lit("?")))).cast(kind)


def wrap(c: Column, bits: int) -> Column:
    """An integer modulo 2^bits, signed; works under any ANSI setting."""
    if bits == 64:
        return c.cast("long")
    half = 1 << (bits - 1)
    return (F.pmod(F.pmod(c, F.lit(1 << bits)) + half, F.lit(1 << bits)) - half).cast({8: "byte", 16: "short", 32: "int"}[bits])


def to_boolean(c: Column, have: T.DataType) -> Column:
    if _is(have, T.StringType):
        return F.when(c.isin(*TRUE), True).when(c.isin(*FALSE), False).when(c.isNotNull(), _failed(c, "a boolean", "boolean"))
    if _is(have, T.BinaryType):
        return F.hex(c).rlike("[1-9A-F]")
    return c != 0


def _from_bytes(c: Column, n: int) -> Column:
    """The first n bytes, lowest first, as an unsigned number in hexadecimal."""
    padded = F.rpad(F.hex(F.substring(c, 1, n)), 2 * n, "0")
    return F.concat(*[F.substring(padded, 2 * i + 1, 2) for i in reversed(range(n))])


def to_integer(c: Column, have: T.DataType, bits: int) -> Column:
    if _is(have, T.StringType):
        value = c.try_cast("long")
        lo, hi = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
        ok = c.rlike(r"^[+-]?[0-9]+$") & value.between(lo, hi)
        name = {8: "byte", 16: "short", 32: "int", 64: "long"}[bits]
        return F.when(ok, value.cast(name)).when(c.isNotNull(), _failed(c, "an integer", name))
    if _is(have, T.BinaryType):
        n = bits // 8
        unsigned = F.conv(_from_bytes(c, n), 16, 10).cast("decimal(20,0)")
        signed = F.when(unsigned >= F.lit(str(1 << (bits - 1))).cast("decimal(20,0)"), unsigned - F.lit(str(1 << bits)).cast("decimal(20,0)")).otherwise(unsigned)
        return signed.cast({8: "byte", 16: "short", 32: "int", 64: "long"}[bits])
    if _is(have, T.BooleanType):
        return c.cast("int").cast({8: "byte", 16: "short", 32: "int", 64: "long"}[bits])
    if _is(have, T.FloatType, T.DoubleType):
        whole = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
        return wrap(whole.cast("long"), bits)
    if _is(have, T.DecimalType):
        whole = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("decimal(38,0)")
        over = F.lit(str(1 << 64)).cast("decimal(38,0)")
        rest, half = whole % over, F.lit(str(1 << 63)).cast("decimal(38,0)")
        return wrap(F.when(rest >= half, rest - over).when(rest < -half, rest + over).otherwise(rest).cast("long"), bits)
    if _is(have, T.DateType):
        return F.unix_date(c).cast({8: "byte", 16: "short", 32: "int", 64: "long"}[bits])
    if _is(have, T.TimestampType, T.TimestampNTZType):
        return wrap(F.unix_micros(c.cast("timestamp")), bits)
    return wrap(c.cast("long"), bits)


def shortest(x: float, single: bool = False) -> str:
    """The shortest text that reads back as this float."""
    import numpy as np

    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    digits = np.format_float_scientific(np.float32(x) if single else x, unique=True, trim="-")
    mantissa, _, exponent = digits.partition("e")
    e = int(exponent)
    if e < -4 or e >= 21:
        return f"{mantissa}e{'-' if e < 0 else '+'}{abs(e):02d}"
    return np.format_float_positional(np.float32(x) if single else x, unique=True, trim="-")


def float_text(c: Column, single: bool) -> Column:
    @F.pandas_udf("string")
    def format_(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else shortest(x, single))

    # pandas shows a null number as NaN, so nulls are taken apart here.
    return F.when(c.isNotNull(), format_(c))


def to_string(c: Column, have: T.DataType, fixed: bool = False) -> Column:
    if _is(have, T.FloatType, T.DoubleType):
        return float_text(c, _is(have, T.FloatType))
    if _is(have, T.BinaryType):
        return F.lower(F.hex(c)) if fixed else c.cast("string")
    if _is(have, T.TimestampType, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    return c.cast("string")


def to_fixed(c: Column, have: T.DataType, n: int) -> Column:
    data = F.unhex(c) if _is(have, T.StringType) else little_endian(c, have)
    return F.unhex(F.rpad(F.hex(F.substring(data, 1, n)), 2 * n, "0"))


def time_of_day(c: Column, unit: int = 1_000_000) -> Column:
    """The time since midnight of a timestamp, in units of 1/unit seconds."""
    micros = F.unix_micros(c.cast("timestamp"))
    return F.expr("1") * F.floor(F.pmod(micros, F.lit(86_400_000_000)) / F.lit(1_000_000 // unit)).cast("long")


def time_text(c: Column) -> Column:
    """Microseconds since midnight as HH:MM:SS with up to three decimals."""
    seconds = F.floor(c / 1_000_000)
    base = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds, F.lit(60)))
    millis = F.floor(F.pmod(c, F.lit(1_000_000)) / 1000)
    return F.when(millis == 0, base).otherwise(F.concat(base, F.lit("."), F.regexp_replace(F.format_string("%03d", millis), "0+$", "")))


def rescale(c: Column, from_unit: int, to_unit: int) -> Column:
    """An integer time from 1/from_unit to 1/to_unit seconds, toward zero."""
    if to_unit >= from_unit:
        return c * (to_unit // from_unit)
    return F.call_function("div", c.cast("long"), F.lit(from_unit // to_unit).cast("long"))


def cast(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return c
    if _is(have, T.NullType):
        return c.cast(want)
    if _is(have, T.ArrayType, T.MapType, T.StructType) or _is(want, T.ArrayType, T.MapType, T.StructType):
        raise ValueError(f"{have.simpleString()} can't be cast to {want.simpleString()}")
    if _is(want, T.BooleanType):
        return to_boolean(c, have)
    if want.typeName() in _INTS:
        return to_integer(c, have, _INTS[want.typeName()])
    if _is(want, T.StringType):
        return to_string(c, have)
    if _is(want, T.BinaryType):
        return little_endian(c, have)
    if _is(want, T.FloatType, T.DoubleType):
        if _is(have, T.BinaryType):
            code = "<f" if _is(want, T.FloatType) else "<d"
            import struct

            @F.pandas_udf(want)
            def bits(s: pd.Series) -> pd.Series:
                n = struct.calcsize(code)
                return s.map(lambda b: struct.unpack(code, bytes(b)[:n].ljust(n, b"\x00"))[0], na_action="ignore").astype("float32" if n == 4 else "float64")

            return bits(c)
        return (c.cast("int") if _is(have, T.BooleanType) else c).cast(want)
    if _is(want, T.DecimalType):
        if _is(have, T.FloatType, T.DoubleType) and want.scale == 0 and want.precision == 29:
            raise ValueError("floats have no 96-bit integer form")
        return (c.cast("int") if _is(have, T.BooleanType) else c).cast(want)
    if _is(want, T.DateType):
        if _is(have, T.StringType):
            return F.when(c.isNotNull(), F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"), _failed(c, "a date", "date")))
        return F.date_from_unix_date(c.cast("int")) if have.typeName() in _INTS else c.cast("date")
    if _is(want, T.TimestampType, T.TimestampNTZType):
        if have.typeName() in _INTS:
            return F.timestamp_micros(c.cast("long")).cast(want)
        if _is(have, T.StringType):
            return F.timestamp_micros(to_integer(c, have, 64)).cast(want)
        return c.cast(want)
    raise ValueError(f"{have.simpleString()} can't be cast to {want.simpleString()}")

"""Column helpers of the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for the row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def times(n: Column) -> Column:
    """0, 1, ..., n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def long(c: Column) -> Column:
    return c.cast("long")

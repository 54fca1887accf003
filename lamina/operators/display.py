"""Display of schemas and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.schema import message
from lamina.functions.values import text


def schema_lines(df: DataFrame, name: str = "schema") -> DataFrame:
    """The Parquet message of a table's schema, one row per line."""
    lines = message(df.schema, name).split("\n")
    return df.sparkSession.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def rows(df: DataFrame) -> DataFrame:
    """Every value in its display form."""
    return df.select(*[text(F.col(c)).alias(c) for c in df.columns])


def table(df: DataFrame, n: int = 20) -> str:
    """The first n rows as a text table."""
    shown = [list(map(str, r)) for r in rows(df.limit(n)).collect()]
    widths = [max(map(len, col)) for col in zip(df.columns, *shown, strict=True)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    return "\n".join([rule, line(df.columns), rule, *map(line, shown), rule])

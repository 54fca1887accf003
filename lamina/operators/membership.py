"""Membership by split-block bloom filters: 32-byte blocks of eight words, one bit in each.

Filters are built in one task per hash range of a column and joined by OR; a probe touches one
block. They answer "maybe" or "no"; exact answers are semi-joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.values import little_endian, xxh64

# The odd constants that give each word of a block its bit.
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
MAX_BYTES = 32 << 20  # filters up to this size are sent to every task


def blocks_for(n_values: int, bits_per_value: int) -> int:
    """The number of blocks for so many values."""
    return max(1, -(-(-(-n_values * bits_per_value // 8)) // 32))


def _block(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    low = h.astype(np.uint32)
    return np.uint32(1) << (low[:, None] * SALT[None, :] >> np.uint32(27))


def insert(words: np.ndarray, hashes: np.ndarray) -> None:
    """Set the bits of all hashes in words (blocks x 8)."""
    np.bitwise_or.at(words, _block(hashes, len(words)), _bits(hashes))


def check(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = _bits(hashes)
    return ((words[_block(hashes, len(words))] & bits) == bits).all(axis=1)


def _hash(df: DataFrame, column: str) -> Column:
    return xxh64(little_endian(F.col(column), df.schema[column].dataType))


def build(df: DataFrame, column: str, bits_per_value: int = 10, n_values: int | None = None) -> np.ndarray:
    """The filter of a column's values; partitions build their own, which are joined by OR.

    Only one filter for each of a few groups of partitions comes back, and its size is checked."""
    n = n_values if n_values is not None else df.select(F.approx_count_distinct(column)).head()[0]
    blocks = blocks_for(n, bits_per_value)
    if blocks * 32 > MAX_BYTES:
        raise ValueError(f"the filter would take {blocks * 32} bytes; use an exact semi-join")

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros((blocks, 8), np.uint32)
        for f in frames:
            insert(words, f["h"].to_numpy(np.int64).view(np.uint64))
        used = np.flatnonzero(words.any(axis=1))
        yield pd.DataFrame({"block": used, **{f"w{i}": words[used, i].astype(np.int64) for i in range(8)}})

    hashes = df.where(F.col(column).isNotNull()).select(_hash(df, column).alias("h"))
    rows = hashes.mapInPandas(local, "block long, " + ", ".join(f"w{i} long" for i in range(8)))
    merged = rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]).toPandas()
    words = np.zeros((blocks, 8), np.uint32)
    if len(merged):
        words[merged["block"].to_numpy()] = merged[[f"w{i}" for i in range(8)]].to_numpy().astype(np.uint32)
    return words


def maybe_in(df: DataFrame, column: str, filters: list[np.ndarray | None]) -> DataFrame:
    """The rows whose value may be in any of the filters; a missing filter means that it may."""
    if any(f is None for f in filters):
        return df

    @F.pandas_udf("boolean")
    def probe(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            known = s.fillna(0).to_numpy(np.int64).view(np.uint64)
            yield pd.Series(np.any([check(f, known) for f in filters], axis=0)) & s.notna().to_numpy()

    return df.where(probe(_hash(df, column)))


def member_of(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The rows whose value is in `values`, exactly."""
    return df.join(values.select(column).distinct(), column, "left_semi")

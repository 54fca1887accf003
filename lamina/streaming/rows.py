"""Row operators on unbounded tables.

Filters, transforms and conversions are the batch functions: they are DataFrame expressions.
Operators that look at earlier rows keep their state by key."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedupe_consecutive(stream: DataFrame, group: str, on: Sequence[str], order: str) -> DataFrame:
    """Drops rows that equal the row before them in the columns `on`, inside each group; the last row
    kept is the state. Rows of one batch are taken in the order of `order`."""
    names = stream.columns

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        # JSON keeps columns apart, and null from any text.
        own = [[None if pd.isna(x) else str(x) for x in rows[c]] for c in on]
        values = pd.Series([json.dumps(x) for x in zip(*own, strict=True)], index=rows.index, dtype=object)
        before = values.shift(1)
        before.iloc[0] = state.get[0] if state.exists else None
        kept = rows[values.ne(before)]
        state.update((values.iloc[-1],))
        yield kept[names]

    return stream.groupBy(group).applyInPandasWithState(step, stream.schema, "last string", "append", GroupStateTimeout.NoTimeout)

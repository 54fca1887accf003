"""Exact top-k inner product search by an impact-ordered index, score at a time.

Components become integers floor(scale * x). The index holds blocks of vectors; in a block, every
component has two impacts, its height above the block's minimum in that dimension and its depth
below the maximum, quantised into at most LEVELS equal steps. A posting list holds the vectors of
one dimension and kind of impact by descending level, cut into segments of equal level.

For a block of queries, |q_d| times the height (q_d > 0) or depth (q_d < 0) adds up to the score,
but for a constant. The segments of all lists are processed by descending level, in batches: each
posting adds its quantised impact, times the query's weight, to the 64-bit accumulator of its
vector (in 32 bits where the bounds of a block allow that). What a vector may still gain is bounded: by the width of a step for each posting that was
seen, and by the highest level left for the weight of those that weren't. Processing stops only
where this proves that all but a few vectors can't reach the k-th best lower bound, or with the
last segment; the vectors that may are rescored exactly. So results are exact whatever the data;
ties go to the smaller id.

All sums are of 64-bit integers; a block whose sums could be beyond them is an error.

Groups of blocks of queries meet groups of blocks of vectors in cells. A block travels once for each
cell of its group, in no join and through no broadcast; a task holds the queries of one cell, of
HELD_BYTES or so, while the cell's vectors pass block by block. It gives the best k of a cell by
query, and these are merged once more.

Vectors that are null or empty, or that hold null or non-finite components, take no part; vectors
meet those of their own length. Repeated ids are separate rows. Extra columns aren't read. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, shuffle_partitions, staged

LEVELS = 128
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 128
HELD_BYTES = 16 << 20  # queries of a cell, with their best k, that a task holds while the cell's vectors pass
#: After each of these shares of the levels, the bound is tried.
TRIES = (0.6, 0.3, 0.2)
#: Processing stops where the possible members are at most so many times k.
ENOUGH = 8


class ImpactBlock:
    """The posting lists of one block, in segments by descending quantised impact.

    List d holds heights above the minimum of dimension d, list dims + d depths below its maximum:
    `order[list]` are the vectors, `ends[list, level]` the end of the segment of `level`."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.low, self.high = low, high
        self.step = max(1, -(-(int((high - low).max()) + 1) // LEVELS))
        levels = np.concatenate([(vectors - low) // self.step, (high - vectors) // self.step], axis=1).T
        self.top = int(levels.max())
        self.order = np.argsort(-levels, axis=1, kind="stable").astype(np.int32)
        self.sorted_levels = np.take_along_axis(levels, self.order, axis=1)
        self.ends = np.stack([np.searchsorted(-row, -np.arange(self.top + 1), "right") for row in self.sorted_levels])


def _integers(data: bytes, n: int, dims: int) -> np.ndarray:
    """The vectors of a packed block, of 32-bit integers or of 64-bit ones."""
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * dims else "<i8").reshape(n, dims).astype(np.int64)


def _within_64_bits(queries: np.ndarray, vectors: np.ndarray) -> None:
    top = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if 4 * (top(queries) + 1) * (top(vectors) + 1) * max(1, queries.shape[1]) >= 1 << 63:
        raise OverflowError("scores beyond 64 bits")


def search_block(block: ImpactBlock, queries: np.ndarray, k: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Possible members of the exact top k, as (query row, vector row, score): every vector that
    isn't among them is proven to score lower than k others. `seen` gets the number of postings that
    were processed and of all postings with a weight."""
    n, q = len(block.vectors), len(queries)
    _within_64_bits(queries, block.vectors)
    # A list's weight for each query: one of a dimension's two lists has none.
    weight = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1).T
    total = weight.sum(axis=0)
    k = min(k, n)
    lists = [(i, w) for i, w in enumerate(weight) if w.any()]
    # An accumulator is (lower edges of what was seen) * unit + (the weight of what was seen); where
    # both don't fit into 64 bits, they have arrays of their own.
    unit = int(total.max(initial=0)) + 1
    most = unit * unit * (block.top + 1) * block.step  # what a joint accumulator holds at most
    joint, kind = most < 1 << 62, np.int32 if most < 1 << 31 else np.int64
    acc = np.zeros((n, q), kind)
    met = None if joint else np.zeros((n, q), np.int64)
    done, above = 0, block.top + 1
    for first in [*(t for t in sorted({int(x * (block.top + 1)) for x in TRIES}, reverse=True) if t > 1), 1]:
        for i, w in lists:
            # The segments of levels first to above - 1, the highest level first.
            begin, end = (block.ends[i, above] if above <= block.top else 0), block.ends[i, first] if first <= block.top else 0
            ids = block.order[i, begin:end]
            if len(ids):
                impact = block.sorted_levels[i, begin:end] * block.step
                acc[ids] += (impact * unit + 1 if joint else impact).astype(kind)[:, None] * w.astype(kind)
                if met is not None:
                    met[ids] += w
                done += len(ids) * int(np.count_nonzero(w))
        above = min(above, first)
        got, seen_weight = np.divmod(acc.astype(np.int64), unit) if met is None else (acc, met)
        # Seen postings gain less than a step, the others are at most of level `above` - 1.
        best = got + (block.step - 1) * seen_weight + (above * block.step - 1) * (total - seen_weight)
        alive = best >= np.partition(got, n - k, axis=0)[n - k]
        if alive.sum() <= ENOUGH * k * q:
            break
    if seen is not None:
        seen += [done, sum(n * int(np.count_nonzero(w)) for _, w in lists)]
    members, rows = np.nonzero(alive)
    score = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), 1 << 14):
        score[i : i + (1 << 14)] = np.einsum("ij,ij->i", queries[rows[i : i + (1 << 14)]], block.vectors[members[i : i + (1 << 14)]])
    return rows, members, score


def _packed_integers(x: np.ndarray) -> bytes:
    narrow = x.astype("<i4")
    return (narrow if (narrow == x).all() else x.astype("<i8")).tobytes()


def packed(vectors: DataFrame, id_column: str, vector_column: str, scale: int, size: int) -> DataFrame:
    """Blocks of at most `size` vectors of equal length, in the order of the input's partitions:
    (block, dims, ids, data), with ids as little-endian 64-bit integers and data as 32-bit ones, or 64-bit ones where they need it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch.column(1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for dims in np.unique(lens):
                pick = np.flatnonzero(lens == dims)
                flat = lists.take(pa.array(pick)).flatten()
                x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pick), int(dims)) * scale)
                if len(x) and np.abs(x).max() >= 2.0**61:
                    raise OverflowError("components beyond 64 bits")
                x = x.astype(np.int64)
                for i in range(0, len(pick), size):
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([(part << 32) + count], pa.int64()), "dims": pa.array([dims], pa.int32()),
                        "ids": pa.array([ids[pick[i : i + size]].astype("<i8").tobytes()], pa.binary()), "data": pa.array([_packed_integers(x[i : i + size])], pa.binary()),
                    })
                    count += 1

    v = F.col(vector_column)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(usable & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    return batched(rows).mapInArrow(pack, "block long, dims int, ids binary, data binary")


def _dealt(blocks: DataFrame, parts: int, groups: int) -> Column:
    """The group of a block: blocks are numbered inside partitions, and taken in turns of the `parts` partitions."""
    number = F.col("block").bitwiseAND((1 << 32) - 1) * parts + F.shiftright("block", 32)
    return F.pmod(number, F.lit(groups)).cast("int")


def _cells(index: DataFrame, asked: DataFrame, k: int, tasks: int) -> tuple[DataFrame, int]:
    """(cell, kind, block, dims, ids, data): the blocks of queries (kind 0) and of vectors (kind 1) of each
    cell, and the number of cells.

    There are as many groups of queries as HELD_BYTES asks for, and cells for all tasks. Beyond that,
    groups are chosen so that both sides travel about as many bytes."""
    sizes = (F.count(F.lit(1)), F.sum(F.length("data")), F.max(F.shiftright("block", 32)), F.sum(F.length("ids")))
    (n, size, last, _), (q_n, q_size, q_last, q_ids) = ([x or 0 for x in t.agg(*sizes).first()] for t in (index, asked))
    share = max(q_size, 1) / max(size, 1)
    held = q_size + 4 * k * q_ids  # a query's id has 8 bytes, each of its best k 32
    q_groups = min(max(1, q_n), max(1, -(-held // HELD_BYTES), round((tasks * share) ** 0.5)))
    groups = min(max(1, n), max(1, -(-tasks // q_groups), round(q_groups / share)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    sent = index.withColumns({"kind": F.lit(1), "h": every(q_groups), "g": _dealt(index, last + 1, groups)})
    asks = asked.withColumns({"kind": F.lit(0), "g": every(groups), "h": _dealt(asked, q_last + 1, q_groups)})
    cell = (F.col("h").cast("long") * groups + F.col("g")).alias("cell")
    return sent.unionByName(asks).select(cell, "kind", "block", "dims", "ids", "data"), q_groups * groups


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries`, the k highest scores among the
    other ids of `vectors` of its length."""
    index = staged(packed(vectors, id_column, vector_column, scale, BLOCK_VECTORS), "index")
    asked = staged(packed(queries, id_column, vector_column, scale, BLOCK_QUERIES), "asked")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell: int | None = None
        held: dict[int, list[tuple[int, np.ndarray, bytes]]] = {}  # per length: blocks of queries
        best: dict[int, np.ndarray] = {}  # per block of queries: (query row, query id, vector id, score) of the best k

        def given() -> Iterator[pd.DataFrame]:
            for q_block, x in best.items():
                yield pd.DataFrame({"query_id": x[1], "q_block": q_block, "q_row": x[0], "vec_id": x[2], "score": x[3]})
            best.clear()
            held.clear()

        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.cell != cell:
                    yield from given()
                    cell = r.cell
                ids = np.frombuffer(r.ids, "<i8")
                if r.kind == 0:
                    held.setdefault(r.dims, []).append((r.block, ids, r.data))
                    continue
                if r.dims not in held:
                    continue
                block = ImpactBlock(_integers(r.data, len(ids), r.dims))
                wanted = k + int(np.unique(ids, return_counts=True)[1].max())
                for q_block, q_ids, q_data in held[r.dims]:
                    rows, members, score = search_block(block, _integers(q_data, len(q_ids), r.dims), wanted)
                    other = q_ids[rows] != ids[members]
                    rows, members = rows[other], members[other]
                    new = np.stack([rows, q_ids[rows], ids[members], score[other]])
                    both = np.concatenate([best[q_block], new], axis=1) if q_block in best else new
                    both = both[:, np.lexsort((both[2], -both[3], both[0]))]
                    best[q_block] = both[:, np.arange(both.shape[1]) - np.searchsorted(both[0], both[0]) < k]
        yield from given()

    # Each block of queries is sent to every group of the index: a stated query set against all rows.
    tasks = shuffle_partitions(vectors.sparkSession)
    rows, cells = _cells(index, asked, k, tasks)
    dealt = rows.repartitionById(min(tasks, cells), F.pmod("cell", F.lit(min(tasks, cells))).cast("int")).sortWithinPartitions("cell", "kind", "block")
    best = batched(dealt).mapInPandas(search, "query_id long, q_block long, q_row long, vec_id long, score long")
    w = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

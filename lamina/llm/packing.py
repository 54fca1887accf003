"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

What there is to pack depends on the lengths alone, and there are at most `capacity` lengths. So
the algorithm works on the histogram of lengths, whose size does not grow with the corpus: a gene
is a group (a filled bin, the lengths in it) with the number of times it occurs. The documents are
put into the groups afterwards, by a rank inside their length.

Evolution is distributed as islands, one Spark task each, for some epochs; after each epoch the
elite of every island moves on to the next one. Crossover injects whole well-filled groups of the
other parent, removes the groups of the first parent that would use a piece twice, and best-fits
the displaced pieces. A solution has at most a few thousand distinct groups.
"""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, dense_rank_in_group, shuffle_partitions, staged
from .pieces import library_encoder, sliced, with_end

ISLANDS, EPOCHS, GENERATIONS, POPULATION = 6, 2, 6, 5
ROWS_PER_BUCKET = 512

Groups = dict[tuple[int, ...], int]  # lengths, longest first -> how many bins are filled so


def best_fit(counts: dict[int, int], capacity: int, rng: random.Random | None = None) -> Groups:
    """Pack a histogram: the longest piece opens a bin, and the longest that still fits follows
    (with rng, now and then a shorter one); the group is repeated as often as its pieces allow."""
    counts = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(counts)
    groups: Groups = {}
    while lengths:
        room, group, used = capacity, [], Counter()
        hi = len(lengths)
        while room > 0:
            i = int(np.searchsorted(lengths[:hi] if hi < len(lengths) else lengths, room, "right")) - 1
            if rng and i > 0 and group and rng.random() < 0.1:
                i = rng.randrange(max(0, i - 8), i + 1)
            while i >= 0 and used[lengths[i]] >= counts[lengths[i]]:
                i -= 1
            if i < 0:
                break
            x = lengths[i]
            take = min(room // x, counts[x] - used[x])
            if rng and take > 1 and rng.random() < 0.2:
                take = 1
            group += [x] * take
            used[x] += take
            room -= x * take
            hi = i + 1
        times = min(counts[x] // n for x, n in used.items())
        key = tuple(sorted(group, reverse=True))
        groups[key] = groups.get(key, 0) + times
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                lengths.remove(x)
    return groups


def fitness(groups: Groups, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones (the mean of squared fills)."""
    bins = sum(groups.values())
    return -bins, sum(n * (sum(g) / capacity) ** 2 for g, n in groups.items()) / max(1, bins)


def crossover(a: Groups, b: Groups, counts: dict[int, int], capacity: int, rng: random.Random) -> Groups:
    """Inject well-filled groups of b into a, remove duplicates, best-fit what was displaced."""
    full = [g for g in b if sum(g) >= capacity - 1]
    injected = {g: b[g] for g in full if rng.random() < 0.5}
    used = Counter()
    for g, n in injected.items():
        for x in g:
            used[x] += n
    for g, n in a.items():
        for x in g:
            used[x] += n
    excess = {x: used[x] - counts[x] for x in used if used[x] > counts[x]}
    child = dict(a)
    # The emptiest groups of a give way first; the worst filled are opened anyway.
    for g in sorted(child, key=sum):
        of = Counter(g)
        gone = max([0, *(-(-excess.get(x, 0) // m) for x, m in of.items() if excess.get(x, 0) > 0)])
        if sum(g) < 0.97 * capacity:
            gone = child[g]
        gone = min(gone, child[g])
        if gone:
            child[g] -= gone
            for x, m in of.items():
                if x in excess:
                    excess[x] -= m * gone
    child = {g: n for g, n in child.items() if n}
    for g, n in injected.items():
        child[g] = child.get(g, 0) + n
    left = dict(counts)
    for g, n in child.items():
        for x in g:
            left[x] -= n
    for g, n in best_fit(left, capacity, rng).items():
        child[g] = child.get(g, 0) + n
    return child


def evolve(counts: dict[int, int], capacity: int, seed: int, elite: list[Groups], generations: int = GENERATIONS, population: int = POPULATION) -> Groups:
    """One island for one epoch; the best solution found."""
    rng = random.Random(seed)
    score = lambda s: fitness(s, capacity)
    pool = [*elite, best_fit(counts, capacity)]
    pool += [best_fit(counts, capacity, rng) for _ in range(max(0, population - len(pool)))]
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    for _ in range(generations):
        best = max(pool, key=score)
        if sum(best.values()) <= bound:
            break
        a, b = (max(rng.sample(pool, 2), key=score) for _ in range(2))
        pool.append(crossover(a, b, counts, capacity, rng))
        pool.remove(min(pool, key=score))
    return max(pool, key=score)


def pack_lengths(spark, counts: dict[int, int], capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> Groups:
    """The best grouping of a histogram of lengths that the islands find."""
    alone = {(capacity,): counts[capacity]} if counts.get(capacity) else {}
    counts = {k: v for k, v in counts.items() if k != capacity and v > 0}
    if not counts:
        return alone
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    elite: list[list[Groups]] = [[] for _ in range(islands)]
    best = best_fit(counts, capacity)
    for epoch in range(epochs):
        if sum(best.values()) <= bound:
            break
        coded = [json.dumps([[[list(g), n] for g, n in s.items()] for s in own]) for own in elite]

        def island(frames: Iterator[pd.DataFrame], coded=coded, epoch=epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in frame["id"]:
                    own = [{tuple(g): n for g, n in s} for s in json.loads(coded[i])]
                    found = evolve(counts, capacity, 1000 * epoch + int(i), own)
                    yield pd.DataFrame({"id": [i], "groups": [json.dumps([[list(g), n] for g, n in found.items()])]})

        rows = spark.range(0, islands, 1, islands).mapInPandas(island, "id long, groups string").collect()
        found = {r.id: {tuple(g): n for g, n in json.loads(r.groups)} for r in rows}
        best = max([best, *(found[i] for i in sorted(found))], key=lambda s: fitness(s, capacity))
        elite = [[found[i], found[(i - 1) % islands]] for i in range(islands)]
    return best | alone


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_path: str, mode: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents: longer ones are cut into `capacity` ids, the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path, mode)
        for batch in batches:
            for i, j in sliced(batch.column(1)):
                flat, rows = with_end(*encoder.encode(batch.column(1).slice(i, j - i)), end_id)
                data = memoryview(flat.astype("<u4")).cast("B")
                n = -(-rows // capacity)
                row = np.repeat(np.arange(len(rows)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = (rows - capacity * (n - 1))[row]
                start = np.where(piece == 0, 0, head + capacity * (piece - 1))
                length = np.where(piece == 0, head, capacity)
                at = (np.cumsum(rows) - rows)[row] + start
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                ids = batch.column(0).slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(cut, _PIECES)


def place(pieces: DataFrame, groups: Groups, capacity: int) -> DataFrame:
    """Adds sequence_id and offset: piece k of its length takes place k among those its length has."""
    first, key, base, times, many, place_at = 0, [], [], [], [], []
    seen: Counter = Counter()
    for g, n in sorted(groups.items()):
        at = 0
        for x, m in sorted(Counter(g).items(), reverse=True):
            key.append((x << 40) + seen[x])
            base.append(first)
            many.append(m)
            place_at.append(at)
            seen[x] += m * n
            at += x * m
        first += n
    order = np.argsort(np.array(key, np.int64))
    key, base, many, place_at = (np.array(v, np.int64)[order] for v in (key, base, many, place_at))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(key, (length << 40) + rank, "right") - 1
            inside = (length << 40) + rank - key[i]
            sequence = base[i] + inside // many[i]
            offset = place_at[i] + inside % many[i] * length
            out = [batch.column(k) for k in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:5], "sequence_id", "offset"])

    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(assign, _PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, mode: str = "byte") -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most `capacity` ids; one row per piece.

    A null text is one end id. Repeated rows are packed each for itself; null ids are kept; extra
    columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    pieces = staged(pieces_of(docs, tokenizer_path, mode, end_id, capacity), "pieces")
    # At most `capacity` rows, whatever the input.
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = pack_lengths(spark, counts, capacity)
    buckets = min(max(1, sum(counts.values()) // ROWS_PER_BUCKET), 8 * shuffle_partitions(spark))
    ranked = dense_rank_in_group(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], F.struct("doc_id", "piece"), "_rank", buckets)
    return place(ranked, groups, capacity)

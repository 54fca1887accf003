"""Token-ID output: a concatenated id array with Elias-Fano coded document boundaries.

File format. A token file is a folder of Parquet containers (so that Spark's committer makes
writes safe against lost executors, on any file system it knows); each row is one segment of
consecutive documents, in ascending doc_id order over (bucket, first_id):

  bucket        part of the doc_id range, ascending with doc_id
  first_id      ids of the bucket before this segment
  n_docs, n_ids counts of the segment
  id_bytes      2 or 4; ids is n_ids little-endian unsigned integers of that width
  end_*         Elias-Fano code of the documents' end offsets inside the segment
  n_null        documents without a doc_id (they come first)
  key_*         Elias-Fano code of doc_id - key_first of the others

An Elias-Fano code of n non-decreasing numbers up to u keeps the low l = floor(log2(u / n)) bits
of each number packed, and the high parts in unary: bit (high_i + i) is set. It takes
n * (2 + l) bits at most, instead of 64 n, and number i is select(i) on the high bits. *_ranks is
its select directory: 32 bits for each 64 bytes of high bits.

Null texts are empty documents (one end id). Rows with equal doc_id are kept, ordered by ids.
An empty table gives an empty file. Long texts are encoded in whole, in a segment as large as they
need. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, shuffle_partitions, staged_path
from .pieces import forget, library_encoder, sliced, with_end

# A segment ends at the first document that reaches so many ids: 256 kB in two bytes each, since the JVM copies
# a segment as one array several times, and arrays of 512 kB are the least that G1 gives regions of their own
# in a heap of 2 GB.
SEGMENT_IDS = 1 << 17
# A reader of the file holds a row group at a time, a writer a page besides; their sizes are looked at after
# each row, as Parquet's writer else does that after 100 rows only, whatever they hold.
_CONTAINER = {"compression": "zstd", "parquet.block.size": 4 << 20, "parquet.block.row.count.limit": 8, "parquet.page.size": 256 << 10, "parquet.page.size.row.check.min": 1}


BLOCK = 64  # bytes of high bits that an entry of the select directory stands for
#: The place of each one in each byte: row b, column j is that of the j-th one of b.
_BIT = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of non-negative integers; ranks is the stored select directory."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, ranks: bytes | None = None):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self._ranks: np.ndarray | None = np.frombuffer(ranks, "<u4") if ranks is not None else None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"")
        l = max(0, int(values[-1] // n).bit_length() - 1)
        high = (values >> l) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1, np.uint8)
        bits[high] = 1
        low = ((values[:, None] >> np.arange(l)) & 1).astype(np.uint8)
        return cls(n, l, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes())

    def decode(self) -> np.ndarray:
        """All numbers."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return (high << self.low_bits) + (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def ranks(self) -> np.ndarray:
        """The select directory: the ones before each 64-byte block of the high bits, and all ones."""
        if self._ranks is None:
            ones = np.bitwise_count(np.pad(self.high, (0, -len(self.high) % BLOCK)).reshape(-1, BLOCK)).sum(axis=1)
            self._ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        return self._ranks

    def select(self, i: np.ndarray | int) -> np.ndarray | int:
        """The number at place i, or the numbers at places i: the directory names the block, its bytes' counts the byte, and a
        table the bit."""
        if np.ndim(i) == 0:
            return int(self.select(np.array([i]))[0])
        i = np.asarray(i, np.int64)
        if i.size and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(i)
        if not i.size:
            return np.zeros(0, np.int64)
        ranks = self.ranks()
        block = np.searchsorted(ranks, i, "right") - 1
        data = np.pad(self.high, (0, -len(self.high) % BLOCK)).reshape(-1, BLOCK)
        used, of = np.unique(block, return_inverse=True)
        counts = np.cumsum(np.bitwise_count(data[used]), axis=1, dtype=np.int64)
        inside = i - ranks[block]
        # Counts of all used blocks in one ascending row: a block's begin at (its place) * 8 * BLOCK.
        row = (counts + np.arange(len(used))[:, None] * 8 * BLOCK).ravel()
        at = np.searchsorted(row, inside + of * 8 * BLOCK, "right") - of * BLOCK
        before = np.where(at > 0, counts[of, np.maximum(at - 1, 0)], 0)
        high = (block * BLOCK + at) * 8 + _BIT[data[block, at], inside - before] - i
        low = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (self.low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << k
        return high << self.low_bits | low

    def size_bits(self) -> int:
        """Bits of the code, without its select directory (a sixteenth of the high bits)."""
        return 8 * (len(self.low) + len(self.high))


_ENCODED = "bucket int, doc_id long, ids binary"
_SEGMENT = "bucket int, first_id long, n_docs long, n_ids long, id_bytes int, ids binary, end_bits int, end_low binary, end_high binary, end_ranks binary, n_null long, key_first long, key_bits int, key_low binary, key_high binary, key_ranks binary"
_SEGMENT_ARROW = pa.schema(
    [("bucket", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("end_bits", pa.int32()), ("end_low", pa.binary()), ("end_high", pa.binary()), ("end_ranks", pa.binary()), ("n_null", pa.int64()), ("key_first", pa.int64()), ("key_bits", pa.int32()), ("key_low", pa.binary()), ("key_high", pa.binary()), ("key_ranks", pa.binary())]
)


def _binary(flat: np.ndarray, rows: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(rows) * flat.dtype.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _segments(bucket: int, first: int, keys: list, ids: list[bytes], width: int) -> dict:
    ends = np.cumsum([len(x) // width for x in ids])
    end, known = EliasFano.of(ends), [k for k in keys if k is not None]
    key = EliasFano.of(np.array(known, np.int64) - known[0] if known else [])
    return {
        "bucket": bucket, "first_id": first, "n_docs": len(ids), "n_ids": int(ends[-1]), "id_bytes": width, "ids": b"".join(ids),
        "end_bits": end.low_bits, "end_low": end.low.tobytes(), "end_high": end.high.tobytes(), "end_ranks": end.ranks().tobytes(),
        "n_null": len(keys) - len(known), "key_first": known[0] if known else 0, "key_bits": key.low_bits, "key_low": key.low.tobytes(), "key_high": key.high.tobytes(), "key_ranks": key.ranks().tobytes(),
    }


@contextmanager
def _short_reads(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """Texts are read from Parquet so many rows at a time: a column's batch is one array, which is copied as it grows."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, mode: str = "word") -> None:
    """Encode docs (doc_id, text) and write the token file `path`.

    One pass encodes; the ids, not the texts, are dealt out by ranges of doc_id (cut at
    quantiles of the id column, which alone is read for that) and sorted inside each range."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("q")).head().q if parts > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path, mode)
        for batch in batches:
            for i, j in sliced(batch.column(1)):
                keys = batch.column(0).slice(i, j - i)
                flat, rows = with_end(*encoder.encode(batch.column(1).slice(i, j - i)), end_id)
                known = keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                bucket = np.searchsorted(cuts, known, "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), keys, _binary(flat, rows)], ["bucket", "doc_id", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        width = library_encoder(tokenizer_path, mode).dtype.itemsize
        bucket, first, keys, ids, held = None, 0, [], [], 0
        for batch in batches:
            for b, key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if ids and (b != bucket or held >= SEGMENT_IDS):
                    yield pa.RecordBatch.from_pylist([_segments(bucket, first, keys, ids, width)], _SEGMENT_ARROW)
                    first, keys, ids, held = first + held, [], [], 0
                if b != bucket:
                    bucket, first = b, 0
                data = x.as_buffer().to_pybytes()
                keys.append(key)
                ids.append(data)
                held += len(data) // width
        if ids:
            yield pa.RecordBatch.from_pylist([_segments(bucket, first, keys, ids, width)], _SEGMENT_ARROW)

    file = (
        batched(docs)
        .mapInArrow(encode, _ENCODED)
        .repartitionById(len(cuts) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(build, _SEGMENT)
    )
    with _short_reads(spark):
        file.write.options(**_CONTAINER).parquet(path)


def read(spark, path: str) -> DataFrame:
    """The documents of a token file: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, segment_bits (Elias-Fano bits of the segment's boundaries) and segment_docs."""
    segments = spark.read.schema(_SEGMENT).parquet(path)
    # One row for each part of the doc_id range, as many as the writer had partitions.
    totals = sorted((r.bucket, r.n) for r in segments.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect())
    before, base = 0, {}
    for bucket, n in totals:
        base[bucket], before = before, before + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for s in batch.to_pylist():
                end = EliasFano(s["n_docs"], s["end_bits"], s["end_low"], s["end_high"], s["end_ranks"])
                key = EliasFano(s["n_docs"] - s["n_null"], s["key_bits"], s["key_low"], s["key_high"], s["key_ranks"])
                ends = end.select(np.arange(end.n))
                starts = np.concatenate([[0], ends[:-1]])
                data = memoryview(np.frombuffer(s["ids"], f"<u{s['id_bytes']}").astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                keys = [None] * s["n_null"] + (key.select(np.arange(key.n)) + s["key_first"]).tolist()
                n = s["n_docs"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts + base[s["bucket"]] + s["first_id"]), pa.array(ends - starts), pa.array(crc, pa.int64()), pa.array(np.full(n, end.size_bits())), pa.array(np.full(n, n))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "segment_bits", "segment_docs"],
                )

    return batched(segments.select(*_SEGMENT_ARROW.names)).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, segment_bits long, segment_docs long")


def offsets(spark, path: str, ids: list[int]) -> DataFrame:
    """doc_id, start and n_tokens of the documents with these ids, by binary search over select on the
    keys and by two selects on the ends: no segment is unpacked and no token id read. Rows with equal
    doc_id give a row each; ids that aren't in the file give none. `ids` goes to every task."""
    segments = spark.read.schema(_SEGMENT).parquet(path)
    totals = sorted((r.bucket, r.n) for r in segments.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect())
    base = dict(zip((b for b, _ in totals), np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist(), strict=False))
    ids = sorted(set(ids))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                end = EliasFano(r["n_docs"], r["end_bits"], r["end_low"], r["end_high"], r["end_ranks"])
                key = EliasFano(r["n_docs"] - r["n_null"], r["key_bits"], r["key_low"], r["key_high"], r["key_ranks"])
                last = key.select(key.n - 1)
                for x in ids[bisect_left(ids, r["key_first"]) : bisect_right(ids, r["key_first"] + last)]:
                    at = bisect_left(range(key.n), x - r["key_first"], key=key.select)
                    while at < key.n and key.select(at) == x - r["key_first"]:
                        i = at + r["n_null"]
                        start, stop = end.select(i - 1) if i else 0, end.select(i)
                        yield pa.RecordBatch.from_pydict({"doc_id": [x], "start": [start + base[r["bucket"]] + r["first_id"]], "n_tokens": [stop - start]})
                        at += 1

    known = segments.where((F.col("n_docs") > F.col("n_null")) & (F.col("key_first") <= (ids[-1] if ids else -(1 << 63))))
    return batched(known.drop("ids")).mapInArrow(find, "doc_id long, start long, n_tokens long")


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 2, mode: str = "word") -> DataFrame:
    """Write docs as a token file in the shared folder and return its documents as read back."""
    path = staged_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, end_id, mode)
    return read(docs.sparkSession, path)

"""Words of many texts as numpy arrays: each word is hashed once for a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) of unsigned 64-bit integers."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string (none may be null)."""
    n = len(strings)
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    lens = np.diff(ends)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[ends[0] : ends[-1]] if n and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    starts = ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(starts, lens)
    terms = mix((data.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return mix(sums[starts + lens] - sums[starts] + lens.astype(np.uint64))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets of each text's words, code of each word, the distinct words). Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    values = lists.flatten().dictionary_encode()
    codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = values.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        some = codes != empty
        offsets = np.concatenate([[0], np.cumsum(some)])[offsets]
        codes = codes[some]
    return offsets, codes, words


def shingles(offsets: np.ndarray, codes: np.ndarray, words: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text's shingles, hash of each shingle): its runs of n words; a text of fewer
    words has one shingle of them all, a text without words has none."""
    h = string_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(offsets)
    out = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(out)])
    row = np.repeat(np.arange(len(count)), out)
    at = offsets[:-1][row] + np.arange(ends[-1]) - ends[:-1][row]
    acc = np.zeros(len(at), np.uint64)
    last = offsets[1:][row]
    for i in range(n):
        inside = at + i < last
        acc = np.where(inside, mix(acc * np.uint64(3) + h[np.minimum(at + i, len(h) - 1)]), acc)
    return ends, acc

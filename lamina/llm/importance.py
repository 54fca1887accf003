"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of the target (texts labelled good), one
of the raw corpus (all texts). A text's log importance weight is the sum over its n-grams of
log(p_target / p_raw). The corpus is resampled by Gumbel top-k: every text gets its log weight,
tempered, plus a Gumbel draw (by its id), and the k highest are kept, which is sampling without
replacement in proportion to the tempered weights. A text's temperature is its number of n-grams
over LENGTH, so that its weight is that of a text of LENGTH n-grams like it: otherwise a long text
would outweigh all short ones by its length alone. k follows from the labels that did not train
the target model: the cut on tempered log weights that best tells good from bad there, and the
number of all texts above it.

N-grams: word unigrams and bigrams, and bigrams of word shapes (case, digits, punctuation, and
whether the word repeats the one before).

Bounds: LABELS labelled rows at most are used, those with the lowest hash of their id; the models
have BUCKETS numbers each. Counts and scores cover all rows and whole texts.

A null or empty text has no n-grams and the log weight 0; long texts are read in whole, and extra
columns of any name go along unread. Rows are judged one by one, so repeated rows get
equal verdicts; a null id is drawn as 0. Without good or bad labels nothing is rejected; an empty
table gives no rows. Texts that tie with the k-th are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, staged
from .pieces import sliced
from .words import mix, string_hashes, words_of

BUCKETS = 1 << 14
LABELS = 20_000
SEED = 17
LENGTH = 100  # n-grams of a text of temperature 1
PRIOR = 20  # pseudo-counts of the target model in an average bucket


def _shapes(words: pa.Array) -> np.ndarray:
    """A small number for each word's shape."""
    bits = [r"[a-z\x{df}-\x{ff}]", r"^[^a-z]*[A-Z][^a-z]*[A-Z]", r"^[A-Z]", r"[0-9]", r"[.,;:?]$", r"[!#$%&*<>|=+~^@_\\]", r"[A-Za-z\x{c0}-\x{ff}]"]
    out = np.zeros(len(words), np.int64)
    for i, p in enumerate(bits):
        out |= pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False).astype(np.int64) << i
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row of each n-gram, bucket of each n-gram)."""
    offsets, codes, words = words_of(texts)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, shape = string_hashes(words), _shapes(words)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inner = row[1:] == row[:-1]
    pair = mix(h[codes[:-1]] * np.uint64(5) + h[codes[1:]])
    form = mix(((shape[codes[:-1]] << 8 | shape[codes[1:]]) << 1 | (codes[:-1] == codes[1:])).astype(np.uint64) + np.uint64(1 << 40))
    grams = np.concatenate([h[codes], pair[inner], form[inner]])
    return np.concatenate([row, row[1:][inner], row[1:][inner]]), (grams % np.uint64(buckets)).astype(np.int64)


def _gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    u = (mix(ids.astype(np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def sample_labels(labels: DataFrame, most: int = LABELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, 1 for good and 0 for bad, 1 where the row trains the target model); ids that
    are labelled both ways count as bad."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(most).orderBy("id").collect()
    ids = np.array([r.id for r in rows], np.int64)
    return ids, np.array([int(r.q > 0) for r in rows], np.int64), (mix(ids.astype(np.uint64)) & np.uint64(1)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = LABELS) -> tuple[np.ndarray, tuple]:
    """The log ratio of each bucket, and the sampled labels."""
    ids, good, train = sample_labels(labels, most)
    target = ids[(good == 1) & (train == 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for i, j in sliced(batch.column(1)):
                keys = batch.column(0).slice(i, j - i)
                row, bucket = features(batch.column(1).slice(i, j - i), buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                chosen = np.isin(keys.fill_null(-1).to_numpy(zero_copy_only=False), target) & keys.is_valid().to_numpy(zero_copy_only=False)
                total[1] += np.bincount(bucket[chosen[row]], minlength=buckets)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    rows = batched(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(count, "bucket long, raw long, target long")
    counts = np.zeros((2, buckets), np.float64)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        counts[:, r.bucket] = r.raw, r.target
    if not counts[1].sum():
        return np.zeros(buckets), (ids, good, train)
    # The target's prior is the raw model, so that a bucket it hardly saw says little.
    raw = (counts[0] + 1) / (counts[0].sum() + buckets)
    prior = PRIOR * buckets * raw
    return np.log((counts[1] + prior) / (counts[1].sum() + prior.sum())) - np.log(raw), (ids, good, train)


def weighted(docs: DataFrame, ratio: np.ndarray, sampled: tuple, seed: int = SEED, whole: bool = False) -> DataFrame:
    """doc_id, log_weight, tempered, score (tempered with the Gumbel draw) and label (1 or 0 for held-out labels, else
    null); with `whole`, in a struct `_weight` beside all columns of docs as a struct `_row`."""
    ids, good, train = sampled
    held, verdict = ids[train == 0], good[train == 0]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_at, text_at = batch.num_columns - 2, batch.num_columns - 1
            for i, j in sliced(batch.column(text_at)):
                part = batch.slice(i, j - i)
                keys = part.column(key_at).fill_null(0).to_numpy(zero_copy_only=False)
                row, bucket = features(part.column(text_at), len(ratio))
                weight = np.bincount(row, ratio[bucket], minlength=j - i)
                tempered = weight / (np.maximum(np.bincount(row, minlength=j - i), 1) / LENGTH)
                at = np.minimum(np.searchsorted(held, keys), max(0, len(held) - 1))
                known = (held[at] == keys) & part.column(key_at).is_valid().to_numpy(zero_copy_only=False) if len(held) else np.zeros(j - i, bool)
                label = pa.array(np.where(known, verdict[at] if len(held) else 0, 0).astype(np.int32), mask=~known)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(text_at)), pa.array(weight), pa.array(tempered), pa.array(tempered + _gumbel(keys, seed)), label], [*part.schema.names[:text_at], "log_weight", "tempered", "score", "label"])

    picked = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType(picked.schema.fields[:-1]).add("log_weight", DoubleType()).add("tempered", DoubleType()).add("score", DoubleType()).add("label", IntegerType())
    return batched(picked).mapInArrow(weigh, schema)


def kth_highest(scores: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th highest value, by counts in ever finer bins (each round reads `bins` counts)."""
    c = F.col(column)
    lo, hi = scores.agg(F.min(c), F.max(c)).head()
    above = 0
    while hi > lo:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        rows = scores.where(c.between(lo, hi)).groupBy(F.least(F.floor((c - lo) / width), F.lit(bins - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.b):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        else:
            return lo
    return lo


def cut_of(rows: DataFrame, column_weight: str, column_score: str, column_label: str) -> float:
    """The lowest score that is kept: that of the k-th highest."""
    # One row for each label, LABELS at most: the mean weight of the rows of its id.
    labelled = rows.where(F.col(column_label).isNotNull()).groupBy("doc_id").agg(F.avg(column_weight).alias("w"), F.max(column_label).alias("y"))
    known = [(r.w, r.y) for r in labelled.collect()]
    w, y = np.array([x[0] for x in known]), np.array([x[1] for x in known])
    if not len(w) or y.all() or not y.any():
        return -np.inf
    order = np.argsort(w, kind="stable")
    w, y = w[order], y[order]
    # Cut below place i: good kept from i on, bad rejected before i; the middle of the widest best gap.
    kept = 1 - np.concatenate([[0], np.cumsum(y)])[:-1] / y.sum()
    gone = np.concatenate([[0], np.cumsum(1 - y)])[:-1] / (1 - y).sum()
    best = np.flatnonzero(kept + gone >= (kept + gone).max() - 1e-12)
    gaps = w[best] - w[np.maximum(best - 1, 0)]
    i = best[int(np.argmax(gaps))]
    tau = (w[i] + w[max(i - 1, 0)]) / 2
    k = rows.where(F.col(column_weight) >= float(tau)).count()
    return kth_highest(rows, column_score, k) if k else float("inf")


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, tempered, score and kept for every document."""
    ratio, sampled = fit(docs, labels)
    rows = staged(weighted(docs, ratio, sampled), "weights")
    cut = cut_of(rows, "tempered", "score", "label")
    return rows.select("doc_id", "log_weight", "tempered", "score", (F.col("score") >= F.lit(cut)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the resampling keeps, with all their columns."""
    ratio, sampled = fit(docs, labels)
    rows = staged(weighted(docs, ratio, sampled, whole=True), "weighted")
    cut = cut_of(rows, "tempered", "score", "label")
    return rows.where(F.col("score") >= F.lit(cut)).select("_row.*")

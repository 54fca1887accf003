"""Near-duplicates in large buckets, and what keep_one keeps, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import neardup
from test_search import brute_classes


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_forest_joins_what_is_linked(monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = random.Random(1)
    texts, cell, out = [], [], []
    for c in range(12):
        base = [rng.choice("abcdefgh") if c % 2 else f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(rng.randint(1, 9)):
            edited = list(base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(60)] = f"q{rng.randrange(4)}"
            texts.append(" ".join(edited))
            cell.append(c)
            out.append(rng.random() < 0.6)
    n = len(texts)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if cell[i] == cell[j] and (out[i] or out[j]) and neardup.overlaps(pa.array([texts[i]]), pa.array([texts[j]]))[0] >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    ends, hashes = neardup.shingles(*neardup.words_of(pa.array(texts)), 5)
    found = neardup.forest(np.array(cell), np.array(out), np.arange(n), ends, hashes)
    assert found.tolist() == [find(i) for i in range(n)]


def group(rng, size, length, most):
    """Copies of one text with ever more edits, so that many share a band and aren't linked."""
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for k in range(size):
        edited = list(base)
        for _ in range(most * k // size):
            edited[rng.randrange(length)] = f"e{rng.randrange(5000)}"
        yield " ".join(edited)


@pytest.mark.parametrize("block", [None, 6_000])
def test_a_large_bucket_loses_no_link(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(5)
    rows = list(enumerate(t for length in (120, 90) for t in group(rng, 220, length, 30)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) > 20


def test_keep_one_judges_texts(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(3, a, 1), (3, b, 2), (5, a + " more", 3), (9, c, 4), (9, c, 5), (9, c, 4), (None, c, 6), (None, c, 7), (None, None, 8), (11, None, 9), (12, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").withColumns({"_gone": F.lit(1), "key": F.lit(2), "sum": F.lit(3), "ROW": F.lit(4)}).repartition(3)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    want = {(3, a, 1), (3, b, 2), (9, c, 4), (None, c, 6), (None, None, 8), (11, None, 9)}
    got = [(r.doc_id, r.text, r.extra) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_one_very_long_text_among_short_ones(spark):
    words = [f"w{i % 4001}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-30])), (3, "w1 w2 w3 w4 w5 w6"), (4, " ".join(words[:20_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == brute_classes(rows)


def test_texts_of_many_shared_buckets_are_opened_once_for_a_leader(spark, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(group(rng, 150, 120, 8)))
    counts = {}

    def counted(df, label, path=None, staged=neardup.staged):
        out = staged(df, label, path)
        counts.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) > 1
    # A text is in up to 40 buckets; those of one leader were opened, joined and sent one by one.
    assert counts["open"][0] <= counts["led"][0] < 0.5 * counts["buckets"][0]

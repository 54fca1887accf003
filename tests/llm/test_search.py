"""Near-duplicates, top-k search, the classifier and the pipeline against brute force and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import SF, check
from lamina.llm import importance, neardup, topk
from lamina.llm.common import table
from lamina.llm.oracles import ORACLES
from lamina.llm.queries import queries
from test_tokens import BYTE, check_packed


def multiset(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    """doc_id -> lowest doc_id of its class."""
    sets = [(i, t or "", multiset(t)) for i, t in rows if i is not None]
    root = {i: i for i, _, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for k, (i, t, m) in enumerate(sets):
        near = {j for g in m for j in seen.get(g, ())}
        near |= {j for j in range(k) if sets[j][1] == t}
        for j in near:
            if sets[j][1] == t or overlap(m, sets[j][2]) >= 0.8:
                a, b = sorted((find(i), find(sets[j][0])))
                root[b] = a
        for g in m:
            seen.setdefault(g, []).append(k)
    return {i: find(i) for i in root}


def near_rows():
    rng = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    rows = [(1000, None), (1001, ""), (1002, ""), (1003, "hi"), (1004, "hi"), (1005, "a b c d e " * 60), (1006, "a b c d e " * 55), (1007, "  hi "), (None, "hi"), (1003, "hi")]
    shared = " ".join(rng.choice(words) for _ in range(60))
    for c in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for k in range(rng.randint(1, 14)):
            edited = list(base)
            for _ in range(rng.randint(0, 7)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((c * 20 + k, " ".join(edited) + (" " + shared if c % 3 == 0 else "")))
    rng.shuffle(rows)
    return rows


def test_near_duplicates_are_the_components_of_all_links(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "key": F.lit(2), "class_id": F.lit(3)}).repartition(4)
    out = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert out == brute_classes(rows)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(out.values()))
    assert kept.where("doc_id IS NULL").count() == 1


def test_texts_that_share_their_lowest_id_all_meet_others(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(500)]
    text = lambda: [rng.choice(words) for _ in range(100)]
    rows = []
    for c in range(12):
        several = [text() for _ in range(3)]
        rows += [(100 * c + 7, " ".join(t)) for t in several]
        rows += [(100 * c + 9 + k, " ".join([*t, f"more{c}"])) for k, t in enumerate(several)]
        rows += [(100 * c + 50, " ".join(text()))]
    want = brute_classes(rows)
    assert all(want[100 * c + 9 + k] == 100 * c + 7 for c in range(12) for k in range(3))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want


def test_near_duplicates_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(df).count() == 0 and neardup.keep_one(df).count() == 0


def test_signatures_estimate_the_weighted_overlap():
    rng = random.Random(7)
    base = [rng.choice("abcdefghijklmnop") for _ in range(300)]
    texts = [" ".join(base)]
    for edits in (3, 12, 40):
        t = list(base)
        for _ in range(edits):
            t[rng.randrange(300)] = "zz"
        texts.append(" ".join(t))
    texts += ["a b c d e " * 50, "a b c d e " * 40, "a b c d e " * 9]
    s = neardup.signatures(*neardup.shingles(*neardup.words_of(pa.array(texts))), 3000)
    for i in range(len(texts)):
        for j in range(i):
            want = overlap(multiset(texts[i]), multiset(texts[j]))
            assert abs((s[i] == s[j]).mean() - want) < 0.05
            assert abs(neardup.overlaps(pa.array([texts[i]]), pa.array([texts[j]]))[0] - want) < 1e-9


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def brute_top(rows, queries_, k):
    ints = {i: np.floor(np.array(v, np.float64) * 64).astype(int) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    return {(q, n + 1, i, s) for q in queries_ if q in ints for n, (s, i) in enumerate(sorted(((int(ints[q] @ v), i) for i, v in ints.items() if i != q), key=lambda x: (-x[0], x[1]))[:k])}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(40)] + [(800, None), (801, [None] * 16), (802, [float("nan")] * 16), (803, [float("inf")] * 16), (None, rows[1][1])]
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).repartition(3)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i is not None]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 20)
    assert {tuple(r) for r in got.collect()} == brute_top(rows32, [i for i, _ in rows32 if i % 20 == 0], 20)
    few = df.where("vec_id < 5")
    assert topk.top_k(few, few.where("vec_id = 0"), 20).count() == 4
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_block_search_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (2000, 32))
    vectors[:30] *= 8
    asked = vectors[:10]
    rows, members, score = topk.search_block(topk.ImpactBlock(vectors), asked, 5)
    assert len(rows) < 10 * 2000 * 0.2
    exact = asked @ vectors.T
    for q in range(10):
        assert sorted(score[rows == q], reverse=True)[:5] == sorted(exact[q], reverse=True)[:5]


@pytest.mark.parametrize("low,spread", [(1 << 24, 3), (1 << 20, 40), (0, 1 << 27)])
def test_block_search_is_exact_for_large_components(low, spread):
    rng = np.random.default_rng(2)
    vectors = low + rng.integers(-spread, spread + 1, (500, 16))
    asked = vectors[:10]
    rows, _, score = topk.search_block(topk.ImpactBlock(vectors), asked, 5)
    exact = asked.astype(object) @ vectors.T.astype(object)
    for q in range(10):
        assert sorted(score[rows == q], reverse=True)[:5] == sorted(exact[q], reverse=True)[:5]


def test_top_k_of_components_over_32_bits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1 if i < 3 else 5e7, 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id < 3"), 5)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, [0, 1, 2], 5)


def test_sql_twins(spark):
    for name, sql in ORACLES.items():
        check(spark, queries()[name], sql)


def test_classifier_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    ids, good, train = importance.sample_labels(labels)
    out = {r.doc_id: r.kept for r in importance.resample(docs, labels).collect()}
    held = [(out[i], bool(g)) for i, g, t in zip(ids.tolist(), good, train, strict=True) if not t and i in out]
    assert len(out) == docs.count() and len(held) > 100
    assert np.mean([k == g for k, g in held]) > 0.95


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = [(i, "good words here and there" if i % 2 else "### bad $$$ ###") for i in range(1, 60)] + [(None, None), (7, ""), (7, "good words"), (7, "good words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "_row": F.lit(1), "label": F.lit(2)})
    out = importance.resample(df, labels)
    assert out.count() == len(rows)
    kept = importance.keep(df, labels)
    assert kept.columns == df.columns and 0 < kept.count() <= len(rows)
    assert importance.keep(df, labels.limit(0)).count() == len(rows)
    assert importance.resample(df.limit(0), labels).count() == 0


def test_kth_highest(spark):
    rng = random.Random(4)
    x = [rng.gauss(0, 1e6) for _ in range(500)] + [5.0] * 50
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for k in (1, 2, 77, 275, 300, 550):
        assert importance.kth_highest(df, "v", k, 8) == sorted(x, reverse=True)[k - 1]


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    from lamina.llm.common import staged

    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows_in = docs.collect()
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= before and now
        if name == "near_dedup":
            assert now == set(brute_classes([(r.doc_id, r.text) for r in rows_in]).values())
        if name == "secret_scan":
            assert now == before and docs.where("text rlike '[0-9a-f]{16}'").isEmpty()
        before = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    from tokenizers import Tokenizer

    check_packed([(r.doc_id, r.text) for r in docs.collect()], out, Tokenizer.from_file(BYTE))


def test_block_search_skips_postings_and_keeps_ties():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-4, 5, (1500, 24))
    vectors[:25] += 60
    asked = np.abs(rng.integers(1, 9, (6, 24)))
    seen = []
    rows, members, score = topk.search_block(topk.ImpactBlock(vectors), asked, 5, seen)
    assert 0 < seen[0] < 0.2 * seen[1]
    exact = asked @ vectors.T
    for q in range(6):
        assert sorted(score[rows == q], reverse=True)[:5] == sorted(exact[q], reverse=True)[:5]
    same = np.tile(rng.integers(-4, 5, (1, 8)), (300, 1))
    rows, members, score = topk.search_block(topk.ImpactBlock(same), same[:2], 5)
    assert len(rows) == 600 and len(set(score.tolist())) == 1
    with pytest.raises(OverflowError):
        topk.search_block(topk.ImpactBlock(same << 40), same[:2] << 40, 5)


def test_log_weights_are_sums_of_log_ratios(spark):
    from collections import Counter as C

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("good nice fine bad ### w1 W2".split()) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(90, None), (91, "word " * 30_000), (3, "good nice"), (None, "fine")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids, good, train = importance.sample_labels(labels)
    target = set(ids[(good == 1) & (train == 1)].tolist())
    grams = lambda t: C(importance.features(pa.array([t], pa.string()))[1].tolist())
    raw, chosen = C(), C()
    for i, t in rows:
        raw.update(grams(t))
        if i in target:
            chosen.update(grams(t))
    n, b = sum(raw.values()), importance.BUCKETS
    p = {g: (raw[g] + 1) / (n + b) for g in raw}
    prior = importance.PRIOR * b
    ratio = {g: np.log((chosen[g] + prior * p[g]) / (sum(chosen.values()) + prior)) - np.log(p[g]) for g in raw}
    got = sorted((r.doc_id is not None, r.doc_id or 0, round(r.log_weight, 6), round(r.tempered, 6)) for r in importance.resample(df, labels).collect())
    want = []
    for i, t in rows:
        g = grams(t)
        w = sum(ratio[x] * c for x, c in g.items())
        want.append((i is not None, i or 0, round(w, 6), round(w * importance.LENGTH / max(1, sum(g.values())), 6)))
    assert np.allclose([x[2:] for x in got], [x[2:] for x in sorted(want)], atol=2e-6) and [x[:2] for x in got] == [x[:2] for x in sorted(want)]


def test_top_k_sends_no_queries_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 6 if i % 7 else 4)]) for i in range(400)]
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 20)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "HELD_BYTES", 1 << 12, raising=False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 20)
    # Queries were copied once for each shuffle partition, and the copies broadcast where the file was small.
    assert not re.search("Broadcast|Join", got._jdf.queryExecution().executedPlan().toString())
    alike = [[r for r in rows if len(r[1]) == n] for n in (4, 6)]
    assert {tuple(r) for r in got.collect()} == set.union(*(brute_top(x, range(0, 400, 20), 20) for x in alike))
    # Every block of queries meets every block of vectors, in one cell.
    index, asked = (topk.packed(x, "vec_id", "embedding", 64, 20) for x in (df, df.where("vec_id % 20 = 0")))
    sent, cells = topk._cells(index, asked, 20, 8)
    assert cells >= 8 and sent.select("cell").distinct().count() <= cells
    met = sent.where("kind = 0").alias("q").join(sent.where("kind = 1").alias("v"), "cell").groupBy("q.block", "v.block").count()
    assert met.count() == index.count() * asked.count() and met.where("count <> 1").count() == 0

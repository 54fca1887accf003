"""Token files, the BPE automaton and packing against the tokenizers library and brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer

from lamina.llm import automaton, packing, tokenfile
from lamina.llm.pieces import library_encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(n=3000):
    rng = random.Random(1)
    bits = list("aaabbthe  \n\t\r'sdmlvre 0129.,!?#éñß中日한😀\xa0　\x0b\x0c\x1c\x85́ΣςK٣½\x01") + ["<|endoftext|>", "<|startoftext|>", " the", " ing", "aaaa", "    ", "\n\n\n"]
    return ["", " ", "\n", "a" * 3000, "the " * 2000] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path,mode", [(BYTE, "byte"), (WORD, "word"), (BYTE, "automaton")])
def test_encoders_equal_the_library(path, mode):
    x = texts()
    encoder = automaton.tokenizer(path).encoder if mode == "automaton" else library_encoder(path, mode)
    flat, rows = encoder.encode(pa.array(x))
    ends = np.cumsum(rows)
    for t, e, end, n in zip(x, Tokenizer.from_file(path).encode_batch(x, add_special_tokens=False), ends, rows, strict=True):
        assert flat[end - n : end].tolist() == e.ids, t


def test_automaton_arcs_are_the_tokenizations_of_pairs():
    """An arc s -> t is there exactly if the merges leave the texts of s and t as these two tokens."""
    t, lib = automaton.tokenizer(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(2)
    words = [i for i, x in enumerate(t.labels[:50256]) if x.isalpha() and x.isascii()]
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        ids = lib.encode((t.labels[a] + t.labels[b]).decode(), add_special_tokens=False).ids
        assert t.automaton.arc(a, b) == (ids == [a, b])


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("ids", "start", "bucket", "_rank", "kept")}) if extra else df


ROWS = [(3, "the quick fox"), (1, None), (2, ""), (None, "no id"), (7, "the quick fox"), (7, "the quick fox"), (5, "naïve café ### <|endoftext|> x"), (4, "word " * 5000)]


def test_encode_decode(spark):
    out = automaton.encode_decode(docs(spark, ROWS, True), BYTE, with_ids=True).collect()
    lib = Tokenizer.from_file(BYTE)
    assert len(out) == len(ROWS)
    for r, (i, text) in zip(out, ROWS, strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (i, len(ids), ids, lib.decode(ids, skip_special_tokens=False))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert automaton.encode_decode(docs(spark, []), BYTE).count() == 0


def brute_file(rows, lib, end):
    start, out = 0, []
    coded = [(i, lib.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]
    for i, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_file(spark):
    rng = random.Random(4)
    rows = ROWS + [(i, "word " * rng.randint(0, 50)) for i in rng.sample(range(10, 10**6), 300)]
    got = tokenfile.token_file(docs(spark, rows, True).repartition(5), WORD).collect()
    want = brute_file(rows, Tokenizer.from_file(WORD), 2)
    assert sorted(map(tuple, ((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted((s, i, n, c) for i, s, n, c in want)
    assert tokenfile.token_file(docs(spark, []), WORD).count() == 0
    assert tokenfile.token_file(docs(spark, [(None, None)]), WORD).count() == 1


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 10**9), (1000, 10), (1000, 10**12), (5000, 5000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    code = tokenfile.EliasFano.of(values)
    again = tokenfile.EliasFano(n, code.low_bits, code.low.tobytes(), code.high.tobytes())
    assert again.decode().tolist() == values.tolist()
    assert [again.select(i) for i in range(0, n, 7)] == values[::7].tolist()
    assert code.size_bits() <= n * (3 + max(0, int(top // max(n, 1)).bit_length())) + 16


@pytest.mark.parametrize("n,top", [(1, 5), (700, 3), (4000, 10**10), (9000, 9000)])
def test_select_by_the_stored_directory(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    code = tokenfile.EliasFano.of(values)
    again = tokenfile.EliasFano(n, code.low_bits, code.low.tobytes(), code.high.tobytes(), code.ranks().tobytes())
    assert again.select(np.arange(n)).tolist() == values.tolist()
    assert again.select(np.arange(n)[::-3]).tolist() == values[::-3].tolist()
    with pytest.raises(IndexError):
        again.select(n)


def test_offsets_of_some_documents(spark, tmp_path):
    rng = random.Random(8)
    rows = ROWS + [(i, "word " * rng.randint(0, 50)) for i in rng.sample(range(10, 10**6), 300)]
    path = str(tmp_path / "tokens")
    tokenfile.write(docs(spark, rows).repartition(3), path, WORD, 2)
    some = [rows[40][0], 7, 4, rows[90][0], 999, -5]
    want = sorted((i, s, n) for i, s, n, _ in brute_file(rows, Tokenizer.from_file(WORD), 2) if i in some)
    assert sorted(map(tuple, tokenfile.offsets(spark, path, some).collect())) == want
    assert tokenfile.offsets(spark, path, []).count() == 0


def test_another_vocabulary_is_encoded_whole(tmp_path):
    import json

    spec = json.load(open(WORD, encoding="utf-8"))
    spec["normalizer"] = None
    path = str(tmp_path / "cased.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    x = ["The Quick fox", "", "a  b\nc", "ÉTÉ's 12"]
    flat, rows = library_encoder(path, "word").encode(pa.array(x))
    assert flat.tolist() == [i for e in Tokenizer.from_file(path).encode_batch(x, add_special_tokens=False) for i in e.ids]
    assert rows.tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(x, add_special_tokens=False)]
    with pytest.raises(ValueError):
        automaton.tokenizer(path)


def test_elias_fano_takes_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert tokenfile.EliasFano.of(ends).size_bits() < 10_000 * 13


def used(groups):
    out = Counter()
    for g, n in groups.items():
        assert sum(g) <= 1024
        for x in g:
            out[x] += n
    return out


def exact_bound(counts):
    """The lower bound that counts pieces over each half and what must go beside them."""
    best = -(-sum(k * v for k, v in counts.items()) // 1024)
    for a in range(0, 513):
        big = sum(v for k, v in counts.items() if k > 1024 - a)
        mid = sum(v for k, v in counts.items() if 512 < k <= 1024 - a)
        room = sum(v * (1024 - k) for k, v in counts.items() if 512 < k <= 1024 - a)
        small = sum(v * k for k, v in counts.items() if a <= k <= 512)
        best = max(best, big + mid + max(0, -(-(small - room) // 1024)))
    return best


@pytest.mark.parametrize("draw", ["uniform", "middle", "small"])
def test_genetic_packing_is_near_the_bound(draw):
    rng = random.Random(3)
    make = {"uniform": lambda: rng.randint(1, 1023), "middle": lambda: int(rng.triangular(200, 800, 400)), "small": lambda: rng.randint(1, 300)}[draw]
    counts = dict(Counter(make() for _ in range(3000)))
    found = packing.evolve(counts, 1024, 1, [])
    assert used(found) == counts
    assert sum(found.values()) <= sum(packing.best_fit(counts, 1024).values())
    assert sum(found.values()) <= 1.03 * exact_bound(counts) + 1


def test_crossover_keeps_all_pieces():
    rng = random.Random(5)
    counts = dict(Counter(rng.randint(1, 1024) for _ in range(800)))
    a, b = packing.best_fit(counts, 1024, rng), packing.best_fit(counts, 1024, rng)
    for _ in range(10):
        a = packing.crossover(a, b, counts, 1024, rng)
        assert used(a) == counts


def check_packed(rows, out, lib):
    by = {}
    for r in out:
        assert 0 <= r.offset and r.offset + r.length <= 1024
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        n = -(-len(ids) // 1024)
        head = len(ids) - 1024 * (n - 1)
        cuts = [0] + [head + 1024 * k for k in range(n)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    return len(by)


def test_pack(spark):
    rng = random.Random(6)
    rows = ROWS + [(i, "word " * rng.randint(0, 2500)) for i in range(100, 220)]
    out = packing.pack(docs(spark, rows, True).repartition(3), BYTE).collect()
    n = check_packed(rows, out, Tokenizer.from_file(BYTE))
    assert n <= 1.05 * -(-sum(r.length for r in out) // 1024) + 1
    assert packing.pack(docs(spark, []), BYTE).count() == 0


def test_token_file_containers_are_of_bounded_size(spark, tmp_path):
    """Equal keys, so one bucket and one container of six million ids: segments and row groups end in time."""
    import pyarrow.parquet as pq

    path, n, words = str(tmp_path / "tokens"), 100, 60_000
    rows_at_once = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    tokenfile.write(docs(spark, [(5, "the fox " * (words // 2))] * n), path, WORD, 2)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == rows_at_once
    one = len(Tokenizer.from_file(WORD).encode("the fox " * (words // 2), add_special_tokens=False).ids) + 1
    groups = []
    for f in os.listdir(path):
        if f.endswith(".parquet"):
            meta = pq.read_metadata(f"{path}/{f}")
            groups += [(meta.row_group(i).num_rows, meta.row_group(i).total_byte_size) for i in range(meta.num_row_groups)]
    sizes = [r.n_ids for r in spark.read.parquet(path).select("n_ids").collect()]
    assert sum(sizes) == n * one and max(sizes) < (1 << 17) + one
    assert sum(r for r, _ in groups) == len(sizes) > 16 and max(r for r, _ in groups) <= 16 and max(b for _, b in groups) < 8 << 20
    got = sorted(tuple(r) for r in tokenfile.read(spark, path).select("start", "doc_id", "n_tokens").collect())
    assert got == [(i * one, 5, one) for i in range(n)]


def test_token_file_is_read_without_the_caches_of_the_encoding(spark, tmp_path, monkeypatch):
    class Stage:
        def mapInArrow(self, task, schema):
            return task

    path, encoder = str(tmp_path / "tokens"), library_encoder(WORD, "word")
    tokenfile.write(docs(spark, ROWS), path, WORD, 2)
    flat, rows = encoder.encode(pa.array(texts(200)))
    assert encoder.cache.held and encoder.parts.held
    monkeypatch.setattr(tokenfile, "batched", lambda df: Stage())
    batches = spark.read.schema(tokenfile._SEGMENT).parquet(path).toArrow().to_batches()
    got = [x for b in tokenfile.read(spark, path)(iter(batches)) for x in b.column("n_tokens").to_pylist()]
    assert sorted(got) == sorted(n for _, _, n, _ in brute_file(ROWS, Tokenizer.from_file(WORD), 2))
    assert not any(c or c.old or c.held for c in (encoder.cache, encoder.parts))
    again = encoder.encode(pa.array(texts(200)))
    assert again[0].tolist() == flat.tolist() and again[1].tolist() == rows.tolist()

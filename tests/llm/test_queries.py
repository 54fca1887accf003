"""The registered queries over their whole tables, and the pipeline over odd ones, against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import SF
from lamina.llm.common import staged, table
from lamina.llm.queries import queries
from test_search import brute_classes
from test_tokens import BYTE, WORD, brute_file, check_packed


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]


def test_op2(spark, documents):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries()["op2_token_file"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_file(documents, Tokenizer.from_file(WORD), 2))


def test_op3(spark):
    groups = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in table(spark, SF, "conversations").collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want.add((c, len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss)))
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries()["op3_chat_round_trip"](spark, SF).collect()} == want


def test_op4(spark, documents):
    assert {r.doc_id: r.class_id for r in queries()["op4_bagminhash_near_dedup"](spark, SF).collect()} == brute_classes(documents)


def test_op5(spark, documents):
    check_packed(documents, queries()["op5_best_fit_packing"](spark, SF).collect(), Tokenizer.from_file(BYTE))


def test_op7(spark, documents):
    rows = queries()["op7_rendezvous_shards"](spark, SF).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, len((t or "").encode()) + 1) for i, t in documents)
    assert all(r.law == "key" and (r.grown_shard == 16 or r.grown_shard == r.shard) for r in rows)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_op8(spark, documents):
    lib = Tokenizer.from_file(BYTE)
    want = set()
    for i, t in documents:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op8_bpe_automaton"](spark, SF).collect()} == want


def test_pipeline_of_odd_tables(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    some = docs.limit(40)
    odd = some.unionByName(some.limit(5)).unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(some.limit(4).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000_000))
    odd = staged(odd.withColumns({"_ledger": F.lit(1), "KEY": F.lit("k"), "score": F.lit(2.0), "spans": F.lit(3), "_clean": F.lit(4)}), "odd")
    for start in (odd, odd.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = staged(stage(spark, now, SF), name)
            assert now.columns == odd.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        assert (packed.count() == 0) == (now.count() == 0)
        assert all(r["_clean"] == 4 and r["KEY"] == "k" for r in now.collect())

"""The native operators against plain Python."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamina.llm import chat, rules, secrets, sharding

SPACE = "\x20\x09-\x0d"


def frame(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in extra})


def fuzz_texts():
    rng = random.Random(9)
    bits = ["a", "bb", "ccc", " ", "  ", "\n", "\t", "\x0b", "\xa0", "#", "$$", "é", "A", "the end of", "\n\n"]
    return [None, "", " \n ", "x " * 4000, "a b c\na b c\na b c"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(400)]


def measured(text):
    t = text or ""
    w = re.findall(f"[^{SPACE}]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    places = {i + d for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if re.search(f"[^{SPACE}]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(places)


def test_rules(spark):
    rows = list(enumerate(fuzz_texts())) + [(None, "x"), (3, "x")]
    out = rules.ledger(frame(spark, rows, ("m", "kept", "failed_bits", "n_words"))).collect()
    want = Counter((i, *measured(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and not (base and r.kept)
    assert rules.ledger(frame(spark, [])).count() == 0


def test_rule_policies_and_ablations(spark):
    rows = list(enumerate(fuzz_texts()))
    df = frame(spark, rows, ("_ledger", "failed_bits"))
    ledger = rules.ledger(df)
    bits = [r.failed_bits for r in ledger.collect()]
    for p in rules.POLICIES:
        m = rules.mask(rules.POLICIES[p])
        kept = rules.keep(df, p)
        assert kept.columns == df.columns
        assert kept.count() == sum(b & (m | 3) == 0 for b in bits)
        for r in rules.ablations(ledger, p).collect():
            bit = 1 << next(x.bit for x in rules.RULES if x.name == r.rule)
            assert (r.n_failed, r.n_failed_only) == (sum(bool(b & bit) for b in bits), sum(b & m == bit for b in bits))
    assert rules.ablations(rules.ledger(frame(spark, []))).count() == len(rules.POLICIES[2])


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets(spark):
    rng = random.Random(5)
    bits = ["token", "=", " ", '"', "'", "password", ": ", "Secret", "API_KEY", "apikey", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "é😀", "x", "abcdefghijkl", "deadbeef", "ghijk", "\n", "ſecret", "K"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(600)] + [(None, "token=abcdefghijklmnop"), (5, None), (6, "x" * 20000)]
    out = secrets.scan(frame(spark, rows, ("_scan", "spans"))).collect()
    want = Counter()
    for i, t in rows:
        b = base(t or "")
        n = Counter(k for _, k, _ in b)
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in b)
        want[i, n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out) == want
    assert secrets.scan(frame(spark, [])).count() == 0


def test_random_tokens_are_told_from_ordinary_ones(spark):
    rng = random.Random(8)
    letters = string.ascii_letters + string.digits
    secret = [(i, "words " + "".join(rng.choice(letters) for _ in range(rng.choice([24, 32, 40, 64]))) + " more") for i in range(150)]
    plain = [(1000 + i, f"words {w} more") for i, w in enumerate(["a" * 34 + "1", "Chapter1Section2Paragraph3Item4", "1111111111111111111111111g", "user_name_2024_final_version_backup_copy", "erenereathingtionbleandanother", "ABABABABABABABABABABABAB12"])]
    out = {r.doc_id: r.n_random for r in secrets.scan(frame(spark, secret + plain)).collect()}
    assert sum(out[i] == 1 for i, _ in secret) >= 0.9 * len(secret)
    assert sum(out[i] for i, _ in plain) == 0


def test_redaction(spark):
    rows = [(1, 'é token = "abcdefghijkl0123" and 0123456789abcdef0 end'), (2, "clean"), (3, None), (3, None)]
    df = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumns({"_row": F.lit(1), "_scan": F.lit(2)})
    out = secrets.redact(df)
    assert out.columns == df.columns and dict(out.dtypes)["n_chars"] == "bigint"
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, 'é [SECRET]" and [SECRET] end', 28), (2, "clean", 5), (3, None, None), (3, None, None)], key=str)


def brute_shard(key, n):
    draw = lambda s: int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16)
    return min(range(n), key=lambda s: (-draw(s), s))


def test_shards(spark):
    rows = [(i, "x" * (i % 7)) for i in range(500)] + [(None, None), (3, "other"), (3, "other"), (9, "é")]
    out = sharding.shards(frame(spark, rows, ("_b", "_r", "slot", "shard")), [1.0] * 16).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for r in out:
        key = "-" if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (brute_shard(key, 16), brute_shard(key, 17))
    for s in range(16):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shards(frame(spark, []), [1.0]).count() == 0


def test_weighted_shards_follow_their_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r.shard for r in sharding.shards(df, [1.0, 2.0, 5.0], [1.0, 2.0, 5.0, 2.0]).collect())
    assert all(abs(n[i] - 20000 * w / 8) < 400 for i, w in enumerate((1, 2, 5)))
    moved = sharding.shards(df, [1.0, 2.0, 5.0], [1.0, 2.0, 5.0, 2.0]).where("shard <> grown_shard")
    assert moved.where("grown_shard <> 3").isEmpty() and abs(moved.count() - 4000) < 400
    with pytest.raises(ValueError):
        sharding.shards(df, [1.0, 0.0])


def test_chat(spark):
    rng = random.Random(3)
    bits = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "a", "\n", "é", "#1\n", "\\\\", "😀", ""]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "user", "x"), (-2, None, None, None), (-3, 1, "assistant", "a" * 30000), (-4, 1, "user", "same"), (-4, 1, "user", "same")]
    for c in range(800):
        for turn in range(rng.randint(1, 4)):
            rows.append((c, turn, rng.choice(["user", "assistant", "sys\ntem", "[OUT]", None, "a b+%é"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(4)
    formatted = chat.format_conversations(df)
    out = {r.conv_id: r for r in chat.digests(formatted).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert len(out) == len(groups)
    for c, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        o = out[c]
        assert (o.n_turns, o.turns_sha256, o.loss_chars, o.loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert formatted.where("conv_id = -4 and formatted like '#0%'").count() == 1
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_long_runs_of_backslashes_are_linear(spark):
    run = "\\" * 40_000
    text = run + "<s> [INST]" + run + "a" + run
    df = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", run)], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_conversations(df)).head()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"assistant\n{text}\nuser\n{run}\n".encode()).hexdigest()


def test_thousands_of_tokens_in_a_text(spark):
    rng = random.Random(3)
    letters = string.ascii_letters + string.digits
    tokens = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(3000)]
    text = "é " + " ".join(tokens)
    r = secrets.scan(frame(spark, [(1, text)])).head()
    places = {f"random:{2 + 31 * i}:{2 + 31 * i + 30}" for i in range(3000)}
    found = {x for x in r.spans.split(",") if x.startswith("random")}
    assert found <= places and len(found) >= 0.9 * 3000


def test_few_readable_identifiers_are_reported(spark):
    """Of what is reported among 1,000 readable identifiers and 100 keys, at least 0.85 are keys, at a recall of 0.9."""
    rng = random.Random(1)
    words = "get user account balance list order item price total count find name address street city open close file read write start stop server client message queue handle error value index table column report".split()
    rows = []
    for i in range(1000):
        some = [rng.choice(words) for _ in range(rng.randint(4, 6))]
        joint = "_/-"[i % 3]
        name = "".join(w.title() for w in some) if i % 4 == 0 else joint.join(some) + joint
        rows.append((i, f"see {name}{rng.randrange(1, 3000)} for more"))
    letters = string.ascii_letters + string.digits
    rows += [(5000 + i, "key " + "".join(rng.choice(letters) for _ in range(rng.choice([24, 32, 40]))) + " end") for i in range(100)]
    out = {r.doc_id: r.n_random > 0 for r in secrets.scan(frame(spark, rows)).collect()}
    keys = sum(v for i, v in out.items() if i >= 5000)
    assert keys >= 90 and keys >= 0.85 * sum(out.values())


def test_keep_of_extra_columns_with_clashing_names(spark):
    rows = [(1, "word " * 30 + "other words in here that do not repeat at all and make a document of some length " + " ".join(f"w{i}" for i in range(60)))]
    df = frame(spark, rows, ("_LEDGER", "_ledger_", "N_WORDS"))
    kept = rules.keep(df, 1)
    assert kept.columns == df.columns and all(r["_LEDGER"] == 1 for r in kept.collect())


def test_one_stored_ledger_serves_all_policies(spark):
    stored = rules.store(frame(spark, list(enumerate(fuzz_texts()))))
    for p in rules.POLICIES:
        m = rules.mask(rules.POLICIES[p]) | 3
        assert all(r.kept == (r.failed_bits & m == 0) for r in rules.verdicts(stored, p).collect())

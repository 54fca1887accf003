"""Quality rules as a bitmask ledger, by DataFrame expressions only.

Every rule is evaluated once for each document; the ledger stores the measurements and one
long whose bit b is set where the rule of bit b failed. A policy is a version and the set of
rules that count: its verdict is `failed_bits & mask = 0`, so that another policy, or the
ablation of any rule, needs no further look at the texts.

A null text has no words (so it fails words_min). Rows are judged one by one: repeated rows and
ids, and null ids, are each kept or not by their own text. Long texts are measured in whole; extra
columns of any name go along with keep(). An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .exprs import SPACES, WORD, let, long, times

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL over the measurements


RULES = [
    Rule("words_min", 0, "n_words < 50"),
    Rule("repeat_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("dup_lines", 3, "n_dup_lines > 0 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("words_long", 4, "word_chars > 25 * n_words"),
    Rule("words_short", 5, "word_chars < 2 * n_words"),
    Rule("capitals", 6, "2 * n_capitals > word_chars"),
]
BASE = ("words_min", "repeat_words")
#: Versioned policies: the rules that count. Never change one; add another.
POLICIES = {1: BASE, 2: ("words_min", "repeat_words", "symbols", "dup_lines", "words_long", "words_short", "capitals")}
CURRENT = 2


def mask(names: tuple[str, ...] | list[str]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Whether any window repeats is told by hashes, in linear time; only then the windows are
    sorted as strings, and the places of those that equal a neighbour are counted."""

    def gram(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def places(s: Column) -> Column:
        n = F.size(s)
        same = lambda k, j: F.coalesce(F.get(s, k)["g"] == F.get(s, j)["g"], F.lit(False))
        starts = F.filter(times(n), lambda k: same(k, k - 1) | same(k, k + 1))
        return let(F.transform(starts, lambda k: F.get(s, k)["i"]), lambda i: F.size(F.array_distinct(F.concat(i, F.transform(i, lambda x: x + 1), F.transform(i, lambda x: x + 2)))))

    def counted(w: Column) -> Column:
        windows = times(F.size(w) - 2)
        hashes = F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        sorted_ = F.sort_array(F.transform(windows, lambda i: F.struct(gram(w, i).alias("g"), i.alias("i"))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(sorted_, places)))

    return let(words, counted)


def measurements(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    bare = F.length(F.translate(text, SPACES, ""))
    return {
        "n_words": long(F.size(words)),
        "word_chars": long(bare),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_dup_lines": long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": long(_repeat_words(words)),
        "n_lines": long(F.size(lines)),
        "n_capitals": long(F.length(text) - F.length(F.translate(text, CAPITALS, ""))),
    }


def _apart(docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    name = "_ledger"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _ledger_column(docs: DataFrame, name: str) -> DataFrame:
    """docs with one struct column: the measurements and failed_bits."""
    measured = F.struct(*[c.alias(k) for k, c in measurements(F.coalesce(F.col("text"), F.lit(""))).items()])
    docs = docs.withColumn(name, let(measured, lambda m: m.withField("failed_bits", sum((F.when(_condition(r, m), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES), F.lit(0).cast("long")))))
    return docs


def _condition(rule: Rule, m: Column) -> Column:
    """rule.fails (products of measurements and numbers, compared, joined by AND) over the struct m."""

    def term(t: str) -> Column:
        out = F.lit(1).cast("long")
        for x in t.split("*"):
            x = x.strip()
            out = out * (F.lit(int(x)).cast("long") if x.isdigit() else m[x])
        return out

    out = F.lit(True)
    for part in rule.fails.split(" AND "):
        a, op, b = re.fullmatch(r"(.*?) ([<>]) (.*)", part).groups()
        out = out & (term(a) < term(b) if op == "<" else term(a) > term(b))
    return out


def store(docs: DataFrame) -> DataFrame:
    """The stored ledger: doc_id, the measurements and failed_bits. The only look at the texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(_ledger_column(docs, "m").select("doc_id", "m.*"), "ledger")


def verdicts(stored: DataFrame, policy: int = CURRENT) -> DataFrame:
    """A stored ledger with base_failed and kept, a policy's verdict, from its bits alone."""
    fails = lambda names: F.col("failed_bits").bitwiseAND(F.lit(mask(names))) != 0
    return stored.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(POLICIES[policy])})


def ledger(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    """doc_id, the measurements, failed_bits, base_failed and kept (the policy's verdict)."""
    return verdicts(store(docs), policy)


def keep(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    name = _apart(docs)
    names = docs.columns
    return _ledger_column(docs, name).where(F.col(name)["failed_bits"].bitwiseAND(F.lit(mask(POLICIES[policy]) | mask(BASE))) == 0).select(*[F.col(f"`{c}`") for c in names])


def ablations(of: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many would be kept
    without it (those that fail nothing else), from the ledger's bits alone; also the bits that
    any and that all documents fail."""
    m = mask(POLICIES[policy])
    bits = F.col("failed_bits").bitwiseAND(F.lit(m))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    sums = of.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_or(bits).alias("any_bits"),
        F.bit_and(bits).alias("all_bits"),
        *[F.sum(F.when(bits.bitwiseAND(F.lit(1 << r.bit)) != 0, 1).otherwise(0)).alias(f"f{r.bit}") for r in rules],
        *[F.sum(F.when(bits == (1 << r.bit), 1).otherwise(0)).alias(f"o{r.bit}") for r in rules],
    )
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.col(f"f{r.bit}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"o{r.bit}"), F.lit(0)).alias("n_failed_only")) for r in rules])
    return sums.select("n", "any_bits", "all_bits", F.inline(rows))

r"""Secret scans with a battery of randomness tests, by DataFrame expressions only.

Base spans come from three fixed patterns (assign, access, hex), leftmost and non-overlapping
for each kind. The method adds spans of kind "random": runs of 20 or more key characters that
overlap no base span and can't be told from random draws over their encoding's alphabet.

For each such token the encoding is inferred from the characters it has (hex, base32, base36,
base62, base64; at least a digit and a letter, since words have letters alone), and four tests
of randomness are made: chi-squared uniformity over the alphabet, and over its digits, vowels,
capital and small consonants and signs (which readable names fill unevenly however short they
are); runs above and below the middle of the alphabet; serial correlation at lag one. Their
p-values are combined by Fisher's method. Tokens are rejected as not random by the Benjamini-Hochberg rule at
level Q inside each length class (longer tokens carry more evidence, so classes have thresholds
of their own); the tokens that remain are reported. The rule needs the ranks of all p-values of
the corpus: they are counted in bins of -log10 p, a table of bounded size.

Positions are code points, end exclusive. A null text is empty. Rows are scanned one by one, so
repeated rows and ids give one row each. Very long texts and tokens are scanned in whole. Tokens
that tie share a bin and so a verdict. Extra columns aren't read by scan() and kept by redact(). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .exprs import let, long, times

# The base patterns, their least lengths and order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
Q = 0.05
BINS = 400  # of a twentieth each of -log10 p
CLASSES = (32, 48, 64)  # lengths at which a class of token lengths begins; the first begins at 20

# Alphabets in order of their digits; the first that holds a token is its encoding.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
]

_SPANS = "array<struct<start:int,kind:int,stop:int>>"
_TOKENS = "array<struct<start:int,kind:int,stop:int,token:string>>"
# The characters of a class; what is in none of them is a sign.
CHARACTERS = (DIGITS, "aeiouAEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "bcdfghjklmnpqrstvwxyz")


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, tokens: bool = False) -> Column:
    """The spans of all matches of `pattern` (with `tokens`, and their text); those whose `group` has under
    `least` characters are dropped."""
    type_ = _TOKENS if tokens else _SPANS

    def of(parts: Column, found: Column, inner: Column) -> Column:
        own = lambda i: [F.get(found, i).alias("token")] if tokens else []
        sizes = F.transform(times(F.size(found)), lambda i: F.struct(F.length(F.get(parts, i)).alias("gap"), F.length(F.get(found, i)).alias("n"), (F.length(F.get(inner, i)) >= least).alias("ok"), *own(i)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(type_).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).alias("stop"), *([x["token"].alias("token")] if tokens else []))
            return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(sizes, zero, step, lambda acc: acc["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    if group:
        spans = let(parts, lambda p: let(found, lambda f: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: of(p, f, g))))
    else:
        spans = let(parts, lambda p: let(found, lambda f: of(p, f, f)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(type_))


def base_spans(text: Column) -> Column:
    return F.concat(matches(text, ASSIGN, 0, 2, 12), matches(text, ACCESS, 1), matches(text, HEX, 2))


def _p_of(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, by the logistic approximation (error under 2e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565 * z * z * z))


def p_random(token: Column) -> Column:
    """The p-value of the battery; null if the token has no encoding, a digit or a letter."""
    alphabet = F.lit(None).cast("string")
    for _, pattern, letters in reversed(ENCODINGS):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def battery(letters: Column) -> Column:
        size, n = F.length(letters).cast("double"), F.length(token).cast("double")
        places = F.transform(F.split(token, ""), lambda c: (F.call_function("instr", letters, c) - 1).cast("double"))
        return let(places, lambda v: _combined(v, size, n, _p_classes(token, letters, size, n)))

    usable = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return F.when(usable, let(alphabet, lambda a: F.when(a.isNotNull(), battery(a))))


def _p_chi(chi: Column, df: Column) -> Column:
    """P of chi-squared or more, by Wilson and Hilferty's cube root."""
    spread = F.lit(2.0) / (9 * df)
    return _p_of((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))


def _p_classes(token: Column, letters: Column, size: Column, n: Column) -> Column:
    """The p-value of the classes' counts, given how many characters of the alphabet are in each."""
    has = lambda x, c: (F.length(x) - F.length(F.translate(x, c, ""))).cast("double")
    every = "".join(CHARACTERS)
    seen = [has(token, c) for c in CHARACTERS] + [n - has(token, every)]
    share = [has(letters, c) / size for c in CHARACTERS] + [1 - has(letters, every) / size]
    chi = sum((F.when(p > 0, F.pow(o - n * p, F.lit(2.0)) / (n * p)).otherwise(0.0) for o, p in zip(seen, share, strict=True)), F.lit(0.0))
    df = sum(((p > 0).cast("double") for p in share), F.lit(-1.0))
    return _p_chi(chi, F.greatest(df, F.lit(1.0)))


def _combined(v: Column, size: Column, n: Column, p_classes: Column) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    squares = total(F.transform(F.array_distinct(v), lambda x: F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0))))
    p_chi = _p_chi(squares * size / n - n, size - 1)

    high = F.transform(v, lambda x: 2 * x >= size)
    n1 = F.size(F.filter(high, lambda x: x)).cast("double")
    runs = let(high, lambda h: 1 + F.size(F.filter(times(F.size(h) - 1), lambda i: F.get(h, i) != F.get(h, i + 1)))).cast("double")
    mean = 2 * n1 * (n - n1) / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(variance > 0, 2 * _p_of(F.abs(runs - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9))))).otherwise(F.lit(1e-6))

    average = total(v) / n

    def serial(m: Column) -> Column:
        centred = F.transform(v, lambda x: x - m)
        return let(centred, lambda c: let(total(F.transform(c, lambda x: x * x)), lambda s: F.when(s > 0, total(F.transform(times(F.size(c) - 1), lambda i: F.get(c, i) * F.get(c, i + 1))) / F.greatest(s, F.lit(1e-9))).otherwise(F.lit(1.0))))

    p_serial = 2 * _p_of(F.abs(let(average, serial) + 1 / n) * F.sqrt(n))
    logs = F.transform(F.array(p_chi, p_classes, p_runs, p_serial), lambda p: -F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30))))
    return let(total(logs), lambda x: F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6))  # 8 degrees of freedom, at 2 x


def _candidates(text: Column, base: Column) -> Column:
    """Tokens that overlap no base span: start, stop, class and bin of -log10 p."""

    def of(spans: Column) -> Column:
        free = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))

        def judged(s: Column) -> Column:
            n = s["stop"] - s["start"]
            klass = sum(((n >= c).cast("int") for c in CLASSES), F.lit(0))
            p = p_random(s["token"])
            bin_ = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * 20), F.lit(BINS - 1)).cast("int")
            return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), klass.alias("klass"), bin_.alias("bin"))

        return F.filter(F.transform(free, judged), lambda c: c["bin"].isNotNull())

    empty = F.array().cast("array<struct<start:int,stop:int,klass:int,bin:int>>")
    return F.when(text.rlike(TOKEN), let(matches(text, TOKEN, 3, tokens=True), of)).otherwise(empty)


def scanned(docs: DataFrame, text: Column) -> DataFrame:
    """docs with the columns `base` and `candidates`."""
    both = let(text, lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), _candidates(t, b).alias("candidates"))))
    return docs.withColumn("_scan", both)


def thresholds(scans: DataFrame) -> dict[int, int]:
    """For each length class, the first bin that is rejected as not random; at most BINS counts a class are read."""
    counts: dict[int, dict[int, int]] = {}
    bins = scans.select(F.explode("_scan.candidates").alias("c")).groupBy("c.klass", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    for r in bins.collect():
        counts.setdefault(r.klass, {})[r.bin] = r.n
    out = {}
    for klass, of in counts.items():
        m, rank, cut = sum(of.values()), 0, BINS
        for b in sorted(of, reverse=True):  # the smallest p first
            rank += of[b]
            if 10 ** (-b / 20) <= rank * Q / m:
                cut = b
        out[klass] = cut
    return out


def _random_spans(candidates: Column, cuts: dict[int, int]) -> Column:
    cut = F.lit(BINS)
    klass = lambda c: c["klass"]

    def passes(c: Column) -> Column:
        limit = cut
        for k, b in cuts.items():
            limit = F.when(klass(c) == k, F.lit(b)).otherwise(limit)
        return c["bin"] < limit

    return F.transform(F.filter(candidates, passes), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and n_random)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    scans = staged(scanned(docs, F.col("text")).select("doc_id", "_scan"), "secrets")
    random = _random_spans(F.col("_scan.candidates"), thresholds(scans))
    count = lambda k: long(F.size(F.filter("_scan.base", lambda s: s["kind"] == k)))
    return scans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_scan.base")), 256).alias("base_sha256"),
        _joined(F.concat(F.col("_scan.base"), random)).alias("spans"),
        long(F.size(random)).alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by `mark` (n_chars follows, where there is one).

    A null text stays null; overlapping spans are replaced once; other columns stay."""
    names = docs.columns
    scan_name, spans_name = "_scan", "_spans"
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    scans = staged(scanned(inner, F.coalesce(F.col("_row.text"), F.lit(""))), "redact")
    spans = F.sort_array(F.concat(F.col(f"{scan_name}.base"), _random_spans(F.col(f"{scan_name}.candidates"), thresholds(scans))))
    text = F.col("_row.text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(apart, piece).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.col(spans_name), zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    out = scans.withColumn(spans_name, spans).withColumn("_clean", F.when(F.size(spans_name) > 0, clean).otherwise(text))
    columns = []
    for c in names:
        if c == "text":
            columns.append(F.col("_clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.size(spans_name) > 0, F.length("_clean")).otherwise(F.col("_row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"_row.`{c}`").alias(c))
    return out.select(*columns)
